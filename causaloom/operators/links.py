"""Links from a physical score to the share of records with a factor, and what they say about winds that were not flown.

A link rises with the score and is fitted on the records counted by score; between scores it is
linear, beyond them it is level.
"""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics_sql as px
from . import ranking, stats

# Winds of the scenarios in knots, and the higher approach speed as a multiple of the stall speed.
WINDS = (10, 20, 25, 30, 35, 40)
FASTER = 1.44


def isotonic_link(rows: DataFrame, score: str, label: str) -> IsotonicRegressionModel:
    """The rising link of ``label`` (0 or 1) on ``score``; rows without either do not count, equal scores share their mean."""
    points = rows.select(F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("y")).filter("score IS NOT NULL AND NOT isnan(score) AND y IS NOT NULL")
    counted = points.groupBy("score").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("n"))
    return IsotonicRegression(featuresCol="score", labelCol="y", weightCol="n").fit(counted)


def calibrated(points: DataFrame, model: IsotonicRegressionModel, score: str, name: str) -> DataFrame:
    """``points`` with the link's value at ``score`` as ``name``."""
    return model.copy({model.featuresCol: score, model.predictionCol: name}).transform(points)


def link_report(rows: DataFrame, score: str, label: str, key: str, k: int = 5) -> DataFrame:
    """One row: n, n_pos, and out of fold auc, brier and mean, with the Brier score of the base rate."""
    usable = rows.select(key, F.col(score).cast("double").alias("score"), F.col(label).alias("y")).filter("score IS NOT NULL AND NOT isnan(score) AND y IS NOT NULL")
    out = stats.isotonic_out_of_fold(usable, "score", "y", key, k, clip=0.0).select(F.lit("link").alias("arm"), key, "y", "p")
    table = ranking.score_table(out)
    whole = ranking.score_summary(table).join(table.groupBy("arm").agg((F.sum(F.col("score") * (F.col("p") + F.col("n"))) / F.sum(F.col("p") + F.col("n"))).alias("mean")), "arm")
    n, share = F.col("n_pos") + F.col("n_neg"), F.try_divide("n_pos", F.col("n_pos") + F.col("n_neg"))
    return whole.select(n.alias("n"), "n_pos", "auc", "brier", "mean", (share * (1 - share)).alias("brier_base"))


def gust_exceedance(wind: str, speed: float) -> Column:
    """Chance that a gust of the recorded wind's strength stalls the aircraft at ``speed`` (knots)."""
    if speed <= px.VS_KT:
        return F.lit(1.0)
    return F.expr(px.p_exceed_dryden(px.stall_gust(px.f(speed)), wind, px.f(speed * px.KT_TO_FPS)))


def shear_margin(wind: str, speed: float) -> Column:
    """Wind that a shear could take away, less what the stall needs, in knots."""
    return F.col(wind).cast("double") - (speed - px.VS_KT)


def wind_scenarios(rows: DataFrame, records: DataFrame, winds: tuple[int, ...] = WINDS, speed: float = px.APPROACH_KT, faster: float = FASTER * px.VS_KT) -> DataFrame:
    """(link, wind_kts, score, calibrated, score_faster, calibrated_faster, rescaled): both links at given winds, as flown and at a higher speed.

    ``rows`` (wind_kts, gust, shear) are the records with a wind and whether they have the factor;
    ``records`` (gust) are all, whose share of the factor the plain rescaling of the exceedance meets on
    average (shear has none).
    """
    spark = rows.sparkSession
    known = rows.filter("wind_kts IS NOT NULL").groupBy("wind_kts", "gust", "shear").agg(F.count("*").alias("n"))
    given = spark.createDataFrame([(float(w),) for w in dict.fromkeys(winds)], "wind_kts double")
    out = None
    for link, score in (("gust", gust_exceedance), ("shear", shear_margin)):
        own = known.select(score("wind_kts", speed).alias("score"), F.col(link).cast("double").alias("y"), "n").filter("score IS NOT NULL AND NOT isnan(score) AND y IS NOT NULL")
        counted = own.groupBy("score").agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("y"), F.sum("n").cast("double").alias("n"))
        model = IsotonicRegression(featuresCol="score", labelCol="y", weightCol="n").fit(counted)
        points = given.select("wind_kts", score("wind_kts", speed).alias("score"), score("wind_kts", faster).alias("score_faster"))
        points = calibrated(calibrated(points, model, "score", "calibrated"), model, "score_faster", "calibrated_faster")
        if link == "gust":
            mean = own.agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("_mean"))
            points = points.crossJoin(mean).crossJoin(records.agg(F.avg(F.col("gust").cast("double")).alias("_share")))  # a row each
            points = points.withColumn("rescaled", F.least(F.lit(1.0), F.try_divide(F.col("_share") * F.col("score"), F.col("_mean"))))
        else:
            points = points.withColumn("rescaled", F.lit(None).cast("double"))
        points = points.select(F.lit(link).alias("link"), "wind_kts", "score", "calibrated", "score_faster", "calibrated_faster", "rescaled")
        out = points if out is None else out.unionByName(points)
    return out
