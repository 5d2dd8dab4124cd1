"""Tables that are computed once and read several times."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, the warehouse's where none is set."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def once(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder and read from there."""
    _folder(df.sparkSession)
    return df.checkpoint()


def once_by_column(df: DataFrame) -> DataFrame:
    """Like :func:`once`, in Parquet: small for values that repeat, and readers take the columns that they need."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Queries that begin in here run under these settings of the session."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def give_back() -> None:
    """Returns freed memory to the system, which a worker that waits for its next task would keep."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many tasks as there are cores, if it comes in fewer; larger inputs stay as they are split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
