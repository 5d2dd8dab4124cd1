"""Connected components of an edge table by label propagation with jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import once


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root), the smallest node reachable; isolated nodes do not appear."""
    half = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    both = once(half.union(half.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = once(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    while True:  # labels only fall, so it ends
        near = both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = hooked.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        jumped = once(hooked.join(up, F.col("root") == F.col("up"), "left").select("node", "old", F.least("root", F.coalesce("up_root", "root")).alias("root")))
        labels = jumped.select("node", "root")
        if not jumped.filter("old <> root").limit(1).count():
            return labels
