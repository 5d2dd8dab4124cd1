"""Rank statistics of scores without a task that sees all scores.

Scores are counted by value, ranged over tasks, summed up within a task, and the sums of
the tasks before are added: two numbers a task and group travel through the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import once


def cumulated(rows: DataFrame, group: str, order: str, values: list[str]) -> DataFrame:
    """``rows`` (one for each ``order`` value of a ``group``) with ``<value>_before``: the sum over the smaller ones of the group."""
    fields = [*rows.schema.fields, StructField("_task", LongType()), *[StructField(f"{v}_before", LongType()) for v in values]]
    placed = rows.repartitionByRange(F.col(group), F.col(order)).sortWithinPartitions(group, order)

    def summed(batches):
        task, carried = TaskContext.get().partitionId(), {}
        for pdf in batches:
            own = pdf.groupby(group, sort=False, dropna=False)
            pdf["_task"] = task
            for v in values:
                pdf[f"{v}_before"] = own[v].cumsum() - pdf[v] + pdf[group].map(lambda g, v=v: carried.get((g, v), 0))
            for g, part in own:
                for v in values:
                    carried[g, v] = carried.get((g, v), 0) + int(part[v].sum())
            yield pdf

    local = once(placed.mapInPandas(summed, StructType(fields)))
    totals, offsets = {}, []
    for r in sorted(local.groupBy(group, "_task").agg(*[F.sum(v).alias(v) for v in values]).collect(), key=lambda r: r["_task"]):  # a row a group and task
        offsets.append((r[group], r["_task"], *[totals.get((r[group], v), 0) for v in values]))
        for v in values:
            totals[r[group], v] = totals.get((r[group], v), 0) + r[v]
    kinds = StructType([rows.schema[group], StructField("_task", LongType()), *[StructField(f"_{v}", LongType()) for v in values]])
    added = local.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, kinds)), [group, "_task"])
    return added.select(*rows.columns, *[(F.col(f"{v}_before") + F.col(f"_{v}")).alias(f"{v}_before") for v in values])


def score_table(scored: DataFrame, group: str = "arm") -> DataFrame:
    """(group, score, p, n, p_before, n_before, p_all, n_all): positives and negatives by score, of smaller scores, and of all."""
    counts = scored.groupBy(group, F.col("p").cast("double").alias("score")).agg(F.sum((F.col("y") == 1).cast("long")).alias("p"), F.sum((F.col("y") == 0).cast("long")).alias("n"))
    return counted_table(counts, group)


def counted_table(counts: DataFrame, group: str = "arm") -> DataFrame:
    """The score table of (group, score, p, n)."""
    table = once(cumulated(counts, group, "score", ["p", "n"]))
    whole = table.groupBy(group).agg(F.sum("p").alias("p_all"), F.sum("n").alias("n_all"))
    return table.join(F.broadcast(whole), group)


def _parts():
    """How a positive of a score ranks among the negatives, and a negative among the positives."""
    return F.try_divide(F.col("n_before") + F.col("n") / 2, F.col("n_all")), F.try_divide(F.col("p_all") - F.col("p_before") - F.col("p") / 2, F.col("p_all"))


def average_ranks(scored: DataFrame, key: str) -> DataFrame:
    """(key, avg_rank) of scored rows (arm, key, y, p): equal scores share the mean of their ranks."""
    table = score_table(scored)
    rank = F.col("p_before") + F.col("n_before") + (F.col("p") + F.col("n") + 1) / 2
    return scored.select("arm", key, F.col("p").cast("double").alias("score")).join(table.select("arm", "score", rank.alias("avg_rank")), ["arm", "score"]).select("arm", key, "avg_rank")


def equal_parts(rows: DataFrame, order: list[str], parts: int = 10) -> DataFrame:
    """``rows`` with ``part``: as many rows in each of the parts, in the order of the columns."""
    names = rows.columns
    placed = cumulated(rows.select(F.lit(0).alias("_g"), F.struct(*order).alias("_o"), *names, F.lit(1).cast("long").alias("_n")), "_g", "_o", ["_n"])
    return placed.withColumn("part", F.floor(F.col("_n_before") * float(parts) / rows.count()).cast("long")).select(*names, "part")


def score_summary(table: DataFrame, group: str = "arm") -> DataFrame:
    """(group, n_pos, n_neg, auc, se, low, high, average_precision, brier) of a score table; standard error and interval of 95 % are DeLong's.

    Without positives or negatives the rank statistics are null, with one of either the
    interval is.  Scores beyond 0 and 1 count as these for the Brier score.
    """
    v10, v01 = _parts()
    above = F.col("p_all") - F.col("p_before"), F.col("n_all") - F.col("n_before")
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    sums = table.groupBy(group).agg(
        F.max("p_all").alias("P"), F.max("n_all").alias("N"), F.sum(F.col("p") * v10).alias("a"), F.sum(F.col("p") * v10 * v10).alias("aa"), F.sum(F.col("n") * v01).alias("b"), F.sum(F.col("n") * v01 * v01).alias("bb"),
        F.try_divide(F.sum(F.col("p") * above[0] / (above[0] + above[1])), F.max("p_all")).alias("average_precision"),
        (F.sum(F.col("p") * (1 - clipped) ** 2 + F.col("n") * clipped**2) / F.sum(F.col("p") + F.col("n"))).alias("brier"),
    )
    variance = lambda s, ss, k: F.try_divide(F.try_divide(F.col(ss) - F.try_divide(F.col(s) ** 2, F.col(k)), F.col(k) - 1), F.col(k))
    both = (F.col("P") > 1) & (F.col("N") > 1)
    se = F.when(both, F.sqrt(F.greatest(F.lit(0.0), variance("a", "aa", "P") + variance("b", "bb", "N"))))
    auc = F.when(F.col("N") > 0, F.try_divide("a", "P"))
    return sums.select(group, F.col("P").alias("n_pos"), F.col("N").alias("n_neg"), auc.alias("auc"), se.alias("se"), (auc - 1.96 * se).alias("low"), (auc + 1.96 * se).alias("high"), "average_precision", "brier")


def paired_difference(scored: DataFrame, table: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """(first, second, difference, se, z, p_two_sided): DeLong's paired test of two arms (arm, key, y, p) on the same records."""
    v10, v01 = _parts()
    parts = table.select("arm", "score", v10.alias("v10"), v01.alias("v01"))
    own = scored.withColumn("score", F.col("p").cast("double")).join(parts, ["arm", "score"]).select("arm", key, "y", F.when(F.col("y") == 1, F.col("v10")).otherwise(F.col("v01")).alias("v"))
    pairs = own.filter(F.col("arm") == first).select(key, "y", F.col("v").alias("a")).join(own.filter(F.col("arm") == second).select(key, F.col("v").alias("b")), key)
    d = F.col("a") - F.col("b")
    sums = pairs.groupBy().agg(*[f(F.when(F.col("y") == t, d)).alias(f"{name}{t}") for t in (1, 0) for f, name in ((F.avg, "mean"), (F.var_samp, "var"), (F.count, "n"))])
    se = F.sqrt(F.try_divide("var1", "n1") + F.try_divide("var0", "n0"))
    z = F.try_divide("mean1", se)

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        from math import erfc, sqrt

        return pd.Series([None if pd.isna(x) else erfc(abs(x) / sqrt(2)) for x in z], dtype="float64")

    return sums.select(F.lit(first).alias("first"), F.lit(second).alias("second"), F.col("mean1").alias("difference"), se.alias("se"), z.alias("z"), tail(z).alias("p_two_sided"))


def reliability(table: DataFrame, group: str = "arm", bins: int = 10) -> DataFrame:
    """(group, bin, p_mean, y_rate, n): mean score and share of positives between the scores' quantiles.

    Quantiles interpolate between neighbouring scores; equal ones make one bin, scores at
    an edge are in the bin below it.
    """
    here = table.withColumn("before", F.col("p_before") + F.col("n_before")).withColumn("here", F.col("p") + F.col("n")).withColumn("all", F.col("p_all") + F.col("n_all"))
    place = here.select(group, "score", "before", "here", "all", F.explode(F.sequence(F.lit(0), F.lit(bins))).alias("k")).withColumn("at", (F.col("all") - 1) * F.col("k") / bins)
    holds = lambda rank: F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("here")), F.col("score"))
    low, high = holds(F.floor("at")), holds(F.ceil("at"))
    found = place.filter(low.isNotNull() | high.isNotNull()).groupBy(group, "k").agg(F.max(low).alias("a"), F.max(high).alias("b"), F.max(F.col("at") - F.floor("at")).alias("part"))
    edges = found.groupBy(group).agg(F.array_sort(F.array_distinct(F.collect_list(F.col("a") + (F.col("b") - F.col("a")) * F.col("part")))).alias("edges"))
    binned = here.join(F.broadcast(edges), group).withColumn("bin", F.greatest(F.lit(0), F.size(F.filter("edges", lambda e: e < F.col("score"))) - 1))
    return binned.groupBy(group, "bin").agg((F.sum(F.col("score") * F.col("here")) / F.sum("here")).alias("p_mean"), (F.sum("p") / F.sum("here")).alias("y_rate"), F.sum("here").alias("n"))
