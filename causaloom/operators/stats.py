"""Resampling statistics, isotonic links, Monte Carlo stall priors and supervised arms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import once

# Sea-level standard atmosphere.
T0, P0, LAPSE, R_AIR, G0 = 288.15, 101325.0, 0.0065, 287.05287, 9.80665


def score_counts(scored: DataFrame) -> DataFrame:
    """(score, p, n): class counts by score, all that rank statistics need."""
    return scored.groupBy("score").agg(F.sum((F.col("y") == 1).cast("long")).alias("p"), F.sum((F.col("y") == 0).cast("long")).alias("n"))


def auc_of(p: np.ndarray, n: np.ndarray) -> float:
    below = np.concatenate([[0], np.cumsum(n)[:-1]])
    return float((p * (below + n / 2)).sum() / (p.sum() * n.sum()))


def bootstrap_auc(scored: DataFrame, rounds: int = 1000, parts: int = 8, seed: int = 3) -> DataFrame:
    """(auc, low, high): class-stratified redraws over the counts by score, spread over ``parts`` tasks."""
    counts = score_counts(scored).select(F.lit(0).alias("g"), "score", "p", "n")
    spread = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def redraw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        p, n = pdf.p.to_numpy(float), pdf.n.to_numpy(float)
        rng = np.random.default_rng([seed, int(pdf.part.iloc[0])])
        draws = [auc_of(rng.multinomial(int(p.sum()), p / p.sum()), rng.multinomial(int(n.sum()), n / n.sum())) for _ in range(rounds // parts)]
        return pd.DataFrame({"draw": draws, "point": auc_of(p, n)})

    drawn = spread.groupBy("part").applyInPandas(redraw, "draw double, point double")
    return drawn.agg(F.first("point").alias("auc"), F.expr("percentile(draw, 0.025)").alias("low"), F.expr("percentile(draw, 0.975)").alias("high"), F.count("*").alias("n_draws"))


def folds(rows: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """Stratified folds in the order of a hash of key and row; rows without a label of 0 or 1 are in none."""
    return numbered(rows.filter(F.col(label) == 0), 11).unionByName(numbered(rows.filter(F.col(label) == 1), 11)).withColumn("fold", ((F.col("_row") - 1) % k).cast("int")).drop("_row")


def isotonic_out_of_fold(rows: DataFrame, score: str = "score", label: str = "y", key: str = "doc_id", k: int = 5, clip: float = 1e-4) -> DataFrame:
    """(key, y, p): isotonic link of every fold fitted on the others."""
    data = folds(rows, label, key, k).withColumn(label, F.col(label).cast("double")).cache()
    out = None
    for fold in range(k):
        model = IsotonicRegression(featuresCol=score, labelCol=label).fit(data.filter(F.col("fold") != fold))
        part = model.transform(data.filter(F.col("fold") == fold)).select(key, F.col(label).alias("y"), F.least(F.lit(1 - clip), F.greatest(F.lit(clip), "prediction")).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def classifier_out_of_fold(rows: DataFrame, features: list[str], kind: str = "logistic", label: str = "y", key: str = "doc_id", k: int = 5) -> DataFrame:
    """(key, y, p): logistic regression (C = 1) or boosted trees, scored out of fold; features are scaled by the rows fitted on."""
    data = VectorAssembler(inputCols=features, outputCol="raw").transform(folds(rows.na.fill(0.0), label, key, k)).withColumn(label, F.col(label).cast("double")).cache()
    sizes = {r.fold: r["count"] for r in data.groupBy("fold").count().collect()}
    out = None
    for fold in range(k):
        others, own = data.filter(F.col("fold") != fold), data.filter(F.col("fold") == fold)
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(others)
        n = sum(sizes.values()) - sizes.get(fold, 0)
        learner = LogisticRegression(labelCol=label, regParam=1.0 / max(1, n), maxIter=50) if kind == "logistic" else GBTClassifier(labelCol=label, maxIter=10, maxDepth=3, seed=1)
        part = learner.fit(scaler.transform(others)).transform(scaler.transform(own))
        part = part.select(key, F.col(label).alias("y"), vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def stall_prior(spark: SparkSession, weight_n: float = 1111 * G0, area: float = 16.2, cl_max: float = 1.55, draws: int = 20_000, seed: int = 5) -> DataFrame:
    """(phase, altitude_kft, p_stall, low, high): chance that a drawn operating point is below its stall speed.

    One task per phase and altitude; draws of weight (triangular), speed and load factor
    (clipped normals) are seeded by both.
    """
    phases = {"takeoff": (1.2, 0.08, 1.05), "climb": (1.45, 0.1, 1.05), "cruise": (1.9, 0.1, 1.05), "maneuvering": (1.5, 0.12, 1.5), "approach": (1.3, 0.09, 1.1), "landing": (1.2, 0.08, 1.05)}
    grid = spark.createDataFrame([(p, float(a)) for p in phases for a in range(0, 11, 2)], "phase string, altitude_kft double")

    def simulate(pdf: pd.DataFrame) -> pd.DataFrame:
        phase, kft = pdf.phase.iloc[0], float(pdf.altitude_kft.iloc[0])
        ratio, spread, load = phases[phase]
        rng = np.random.default_rng([seed, sorted(phases).index(phase), int(kft)])
        t = T0 - LAPSE * kft * 304.8
        rho = P0 * (t / T0) ** (G0 / (R_AIR * LAPSE)) / (R_AIR * t)
        weight = rng.triangular(0.75, 0.95, 1.0, draws) * weight_n
        n = np.clip(rng.normal(load, 0.15, draws), 0.5, 3.8)
        reference = np.sqrt(2 * weight_n / (P0 / (R_AIR * T0) * area * cl_max))
        speed = np.clip(rng.normal(ratio, spread, draws), 0.6, 3.0) * reference * np.sqrt(P0 / (R_AIR * T0) / rho)
        stalled = speed < np.sqrt(2 * n * weight / (rho * area * cl_max))
        p = stalled.mean()
        again = rng.binomial(draws, p, 400) / draws
        return pd.DataFrame([(phase, kft, float(p), float(np.percentile(again, 2.5)), float(np.percentile(again, 97.5)))], columns=["phase", "altitude_kft", "p_stall", "low", "high"])

    return grid.groupBy("phase", "altitude_kft").applyInPandas(simulate, "phase string, altitude_kft double, p_stall double, low double, high double")


def numbered(df: DataFrame, salt: int) -> DataFrame:
    """``df`` with ``_row``: places from 1 in the order of a salted hash of the row.

    Places come from a range partitioning on the hash (counts by partition give the
    offsets), so that no task orders all rows; the numbered rows are written once.
    """
    ids = df.withColumn("_h", F.xxhash64(F.lit(salt), *df.columns)).repartitionByRange(F.col("_h"), *df.columns).sortWithinPartitions("_h", *df.columns)
    ids = once(ids.drop("_h").withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.p, r["count"]) for r in ids.groupBy(part.alias("p")).count().collect())  # a row a partition
    total, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p long, _o long")
    return ids.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn("_row", F.col("_o") + place + 1).drop("_p", "_o", "_at")


def permuted_pairs(left: DataFrame, right: DataFrame, seed: int = 2) -> DataFrame:
    """Null arm: the rows of ``right`` dealt to those of ``left`` in another, seeded order."""
    return numbered(left, seed).join(numbered(right, seed + 1), "_row").drop("_row")
