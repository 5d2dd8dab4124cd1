"""Shared helpers: checkpoint tables, byte-exact tokens, stable hashes."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the token definition ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Entries a per-worker word cache may hold before it starts afresh.
CACHE_WORDS = 400_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; the warehouse, which is shared too, where none is configured."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it.

    This cuts the lineage and survives lost executors: the rows live in storage
    that every executor shares.  ``batch_rows`` bounds the rows of the Arrow batches that
    are made meanwhile, for rows that are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/causaloom/{uuid.uuid4().hex}-{name}"
    before = spark.conf.get(_BATCH_ROWS)
    try:
        if batch_rows:
            spark.conf.set(_BATCH_ROWS, str(batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def as_binary(column) -> pa.Array:
    """An Arrow string or binary column as binary, nulls kept."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    if pa.types.is_string(kind):
        return column.cast(pa.binary())
    if pa.types.is_large_string(kind):
        return column.cast(pa.large_binary())
    return column


def pieces(batch: pa.RecordBatch, rows: int = 1024, max_bytes: int = 8_000_000):
    """Slices of a batch of at most ``rows`` rows and about ``max_bytes`` bytes (one row at least)."""
    n = batch.num_rows
    step = max(1, min(rows, int(n * max_bytes / max(1, batch.nbytes))))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"_{base}{i or ''}" for i in range(len(taken) + 1)) if n not in taken)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of uint64 (finaliser of the splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def _random(n: int, salt: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


class Words:
    """The words of texts as places in one buffer: ``starts``, ``sizes`` in bytes, ``lengths`` (words of each text)."""

    def __init__(self, texts: list[bytes | None]):
        self.bytes = np.frombuffer(b" ".join([t or b"" for t in texts]), np.uint8)
        space = _SPACE[self.bytes]
        edge = np.diff(space.view(np.int8), prepend=1, append=1)
        self.starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.sizes = ends - self.starts
        texts_end = np.cumsum([len(t or b"") + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.lengths = np.diff(np.searchsorted(self.starts, texts_end), prepend=0)

    def ranks(self, counted: np.ndarray) -> np.ndarray:
        """How many of the counted bytes of its word come before each byte; the bytes before the first word are left out."""
        before = np.cumsum(counted, dtype=np.int32) - counted
        gaps = np.diff(self.starts, append=len(self.bytes))
        return before[self.starts[0] :] - np.repeat(before[self.starts], gaps)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of each word's bytes, from the first word on; bytes between words must have zeros."""
        return np.add.reduceat(values, self.starts - self.starts[0])


_BYTES = _random(256, 1)[_LOWER]
_BYTES[_SPACE] = 0


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of the texts, A-Z in lower case; number of words of each text).

    A word is the sum of its bytes' random numbers, each times an odd random number of
    its place, scrambled with its size.
    """
    w = Words(texts)
    if not len(w.starts):
        return np.zeros(0, np.uint64), w.lengths
    most = int(w.sizes.max())
    places = np.minimum(w.ranks(np.ones(len(w.bytes), np.int32)), most)  # bytes between words may count on
    factors = _random(most + 1, 2) | np.uint64(1)
    return mix64(w.sums(_BYTES[w.bytes[w.starts[0] :]] * factors[places]) ^ (w.sizes.astype(np.uint64) << np.uint64(40))), w.lengths


def fold(id_column, modulus: int):
    """``crc32(doc_id as text) mod modulus`` as a column; null ids count as the text ''."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def give_back() -> None:
    """Returns freed memory to the system, which a worker that waits for its next task would keep."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def by_group(made):
    """``made(key, batches) -> batches`` as a function for ``groupBy().applyInArrow``."""

    def apply(key, table):
        out = pa.Table.from_batches(list(made(key, table.to_batches())))
        give_back()
        return out

    return apply
