"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): root is the smallest node reachable from each node of an edge.

    Each round takes the least label among a node's neighbours and then jumps to the
    label of that label, so that chains shorten by half a round and stars end after
    two.  Labels of a round are written to the shared folder, which cuts the lineage;
    only the number of changed labels comes to the driver.  Both joins are plain
    equi-joins whose skewed keys (hubs) Spark may split.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    both = stored(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "labels")
    while True:  # labels only fall, so it ends
        near = both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        hooked = stored(labels.join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "hooked")
        up = hooked.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        jumped = stored(hooked.join(up, F.col("root") == F.col("up"), "left").select("node", "old", F.least("root", F.coalesce("up_root", "root")).alias("root")), "labels")
        labels = jumped.select("node", "root")
        if jumped.filter("old <> root").limit(1).count() == 0:
            return labels
