"""Named relational operators: one logical plan each, written once.

An operator is a SQL body over named inputs.  Inputs are either tables or *fixtures*
(views derived from the tables); :func:`statement` puts the fixtures that a body needs,
and those that they need, in front of it.  Users run an operator on their own frames
with :func:`apply`, which binds frames to input names instead.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect import DUCK, SPARK, Spark

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FIXTURES: dict[str, Callable[[Spark], str]] = {}
OPERATORS: dict[str, Callable[[Spark], str]] = {}
#: Queries that are not one statement: name -> callable(spark, sf_dir).
CUSTOM: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def fixture(make: Callable[[Spark], str]):
    FIXTURES[make.__name__] = make
    return make


def operator(make: Callable[[Spark], str]):
    OPERATORS[make.__name__] = make
    return make


def custom(make):
    CUSTOM[make.__name__] = make
    return make


def _names(sql: str, among) -> list[str]:
    found = dict.fromkeys(re.findall(r"\b[a-z_][a-z0-9_]*\b", sql))
    return [n for n in found if n in among]


def statement(body: str, dialect: Spark) -> str:
    """The body with the fixtures it needs as common table expressions."""
    ordered: dict[str, str] = {}

    def need(sql: str, own: str | None = None) -> None:
        for name in _names(sql, FIXTURES):
            if name != own and name not in ordered:
                inner = FIXTURES[name](dialect)
                need(inner, name)
                ordered[name] = inner

    need(body)
    if not ordered:
        return body
    head = ", ".join(f"{n} AS ({sql})" for n, sql in ordered.items())
    body = body.lstrip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def tables_of(sql: str) -> list[str]:
    return _names(sql, TABLES)


def _bind(spark: SparkSession, sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    """Run ``sql`` with its inputs bound to frames, under view names that clash with nobody's."""
    tag = uuid.uuid4().hex[:10]
    heads = []
    for name, frame in frames.items():
        frame.createOrReplaceTempView(f"{name}_{tag}")
        heads.append(f"{name} AS (SELECT * FROM {name}_{tag})")
    if heads:
        head = "WITH " + ", ".join(heads)
        sql = f"{head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"{head} {sql}"
    out = spark.sql(sql)
    for name in frames:
        spark.catalog.dropTempView(f"{name}_{tag}")
    return out


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = statement(OPERATORS[name](SPARK), SPARK)
        return _bind(spark, sql, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})

    return run


def apply(name: str, spark: SparkSession, **frames: DataFrame) -> DataFrame:
    """Run operator ``name`` on the given frames, which stand for its inputs of those names.

    Chains (``nodes``) without a ``vocabulary`` (factor_type, is_outcome) take every factor
    that they have; outcomes are those that some node is classed as.
    """
    if "nodes" in frames and "vocabulary" not in frames and {"class", "factor_type"} <= set(frames["nodes"].columns):
        frames["vocabulary"] = frames["nodes"].groupBy("factor_type").agg(F.max(F.col("class") == "outcome").alias("is_outcome"))
    body = OPERATORS[name](SPARK)
    kept = {n: f for n, f in FIXTURES.items() if n in frames}
    for n in kept:
        del FIXTURES[n]
    try:
        sql = statement(body, SPARK)
    finally:
        FIXTURES.update(kept)
    return _bind(spark, sql, frames)


def oracle(name: str) -> str:
    return statement(OPERATORS[name](DUCK), DUCK)
