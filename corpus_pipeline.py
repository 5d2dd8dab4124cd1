"""Corpus pipeline: five stages over ``documents``, each on all that the one before kept.

The stages return the columns of ``documents``; the last adds what the mix takes of
each document.  Every stage states in its operator's docstring what it does with null
and empty texts, ties, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causaloom.llm._common import stored
from causaloom.llm.decontam import find_leaks
from causaloom.llm.line_dedup import drop_boilerplate
from causaloom.llm.mixing import mix_sources
from causaloom.llm.ngram_join import similar_documents
from causaloom.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go; it learns from all labelled rows up to its bound."""
    machine = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), modulus=1, held=-1)
    return score_toxicity(docs, machine).filter("toxic_predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source leave its documents; every document stays."""
    return drop_boilerplate(docs).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the row of smallest doc_id stays; of rows that repeat it, text and all, one.

    Rows are decided one by one, by id and text, so that a null or repeated id loses no
    text of its own.
    """
    similar = stored(similar_documents(docs.select("doc_id", "text")), "similar")
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("key", F.xxhash64(F.col("row.text").cast("string")))

    def those(found: DataFrame, how: str) -> DataFrame:
        by = found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("its")).distinct()
        return rows.join(by, F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("key") == F.col("its")), how)

    kept = similar.filter("kept and n_shingles > 0").groupBy("doc_id", "text_key").count().filter("count > 1")
    repeated = stored(kept, "repeated")
    gone = similar.filter("not kept").select("doc_id", "text_key")
    if not repeated.limit(1).count():
        return those(gone, "left_anti").select("row.*")
    one = those(repeated, "left_semi").groupBy(F.col("row.doc_id").alias("id"), "key").agg(F.first("row").alias("row"))
    return those(gone.union(repeated.select("doc_id", "text_key")), "left_anti").select("row.*").union(one.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(F.size("leaks") == 0).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, with its output shards."""
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontaminate", decontaminate), ("mixing", mixing)]

#: A fitted model rejects documents in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
