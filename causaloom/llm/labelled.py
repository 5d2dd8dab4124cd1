"""Labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled rows outside the held-out fold.

    The sample is the rows of smallest id hash, so it does not depend on the
    partitioning.  Rows whose label is not 0 or 1 or whose id is null are no
    examples; of several labels for one id the larger counts.  The bound is what
    makes the broadcast safe: ``bound`` pairs of two numbers.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), modulus) != held))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
