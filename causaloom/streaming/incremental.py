"""Edge supports kept up to date from a stream of extraction rows.

Supports are sums over records, so a micro-batch adds its own counts: each batch is
written under its number (a batch that runs again replaces its part), and
:func:`current` sums the parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def edge_counts(links: DataFrame) -> DataFrame:
    """(record_id, src, dst) links -> (src, dst, support), a record counting once."""
    return links.select("record_id", "src", "dst").distinct().groupBy("src", "dst").agg(F.count("*").alias("support"))


def maintain(links: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Follow a stream of (record_id, src, dst); rows of one record must come in one batch."""

    def part(batch: DataFrame, number: int) -> None:
        edge_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = links.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("src", "dst").agg(F.sum("support").alias("support"))
