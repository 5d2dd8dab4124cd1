"""Arms of an occurrence model on later years: physics, corpus, both, and both with corrupted physics; windows of training years.

Everything that is learned (vocabularies of the categories, scales, links, weights) is
learned on the training rows of the split, window or fold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import paired_difference, reliability, score_summary, score_table
from .shared import once
from .stats import folds, numbered

EPS = 1e-4
#: Values of categories that an encoder can tell apart.
VALUES = 1 << 20


@dataclass
class Columns:
    """What the harness reads of the rows."""

    key: str = "record_id"
    year: str = "year"
    label: str = "y"
    chart: str = "chart"
    margin: str = "margin"
    categories: list[str] = field(default_factory=list)
    weather: list[str] = field(default_factory=list)


def encoder(categories: list[str], numbers: list[str], least: int = 1) -> Pipeline:
    """Sparse indicators of the category values that at least ``least`` training rows have, and scaled numbers.

    Other values, those that training has not seen among them, have no indicator; null is
    a value of its own.  Numbers must not be null.
    """
    stages = [CountVectorizer(inputCol="_values", outputCol="_hot", minDF=float(least), vocabSize=VALUES, binary=True)] if categories else []
    if numbers:
        stages += [VectorAssembler(inputCols=numbers, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True)]
    parts = (["_hot"] if categories else []) + (["_scaled"] if numbers else [])
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def with_values(rows: DataFrame, categories: list[str]) -> DataFrame:
    """``rows`` with the category values as words."""
    return rows.withColumn("_values", F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("UNK"))) for c in categories])) if categories else rows


def logistic(train: DataFrame, test: DataFrame, categories: list[str], numbers: list[str], c: Columns, least: int = 1, strength: float = 1.0) -> DataFrame:
    """(key, y, p) of the test rows by a logistic model with a ridge of 1 / (2 ``strength``) on all weights."""
    made = encoder(categories, numbers, least).fit(with_values(train, categories))
    rows = once(made.transform(with_values(train, categories)).select(F.col(c.label).cast("double").alias("label"), "features"))
    model = LogisticRegression(labelCol="label", regParam=1.0 / (strength * max(1, rows.count())), standardization=False, maxIter=200).fit(rows)
    return model.transform(made.transform(with_values(test, categories))).select(F.col(c.key), F.col(c.label).alias("y"), vector_to_array("probability")[1].alias("p"))


def linked(train: DataFrame, others: list[DataFrame], c: Columns) -> list[DataFrame]:
    """``others`` with ``link``: the share of positives at a margin by an increasing fit to the training rows, flat beyond them."""
    rows = train.select(F.col(c.label).cast("double").alias("label"), F.col(c.margin).cast("double").alias("_margin"))
    model = IsotonicRegression(featuresCol="_margin", labelCol="label").fit(rows)
    return [model.transform(x.withColumn("_margin", F.col(c.margin).cast("double"))).withColumnRenamed("prediction", "link").drop("_margin") for x in others]


def hybrid(train: DataFrame, test: DataFrame, c: Columns, least: int = 1) -> DataFrame:
    """(key, y, p) of categories and the log odds of the linked margin."""
    a, b = (x.withColumn("_phys", F.log((F.col("link") + EPS) / (1 - F.col("link") + EPS))) for x in linked(train, [train, test], c))
    return logistic(a, b, c.categories, ["_phys"], c, least)


def dealt_margins(rows: DataFrame, c: Columns, seed: int) -> DataFrame:
    """``rows`` with their margins dealt to each other."""
    mixed = numbered(rows.select(F.col(c.margin).alias("_other"), c.key), seed).select("_row", "_other")
    return numbered(rows, seed + 1).join(mixed, "_row").withColumn(c.margin, F.col("_other")).drop("_row", "_other")


def arms(train: DataFrame, test: DataFrame, c: Columns, seed: int = 0, corrupted: bool = True, least: int = 1) -> DataFrame:
    """(arm, key, y, p) of all arms on the test rows."""
    turned = lambda rows: rows.withColumn(c.margin, -F.col(c.margin))
    plain = lambda rows, p: rows.select(F.col(c.key), F.col(c.label).alias("y"), F.col(p).alias("p"))
    made = {
        "physics": plain(test, c.chart), "physics_calibrated": plain(linked(train, [test], c)[0], "link"), "corpus": logistic(train, test, c.categories, [], c, least),
        "raw_weather": logistic(train, test, c.categories, c.weather, c, least), "hybrid": hybrid(train, test, c, least),
    }
    if corrupted:
        made["hybrid_inverted"] = hybrid(turned(train), turned(test), c, least)
        made["hybrid_permuted"] = hybrid(dealt_margins(train, c, seed), dealt_margins(test, c, seed + 2), c, least)
    out = None
    for name, scored in made.items():
        part = scored.select(F.lit(name).alias("arm"), c.key, F.col("y").cast("int").alias("y"), "p")
        out = part if out is None else out.unionByName(part)
    return once(out)


def time_split(rows: DataFrame, c: Columns, split: int, seed: int = 0, least: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(arms with their statistics, paired differences, reliability of the hybrid) on the rows from year ``split`` on, learned before.

    Rows without a year or label take no part.  Both sides of the split need both labels.
    """
    rows = once(rows.filter(F.col(c.year).isNotNull() & F.col(c.label).isNotNull()))
    scored = arms(rows.filter(F.col(c.year) < split), rows.filter(F.col(c.year) >= split), c, seed, least=least)
    table = once(score_table(scored))
    pairs = paired_difference(scored, table, "raw_weather", "hybrid", c.key).union(paired_difference(scored, table, "hybrid", "corpus", c.key))
    return score_summary(table), pairs, reliability(table.filter("arm = 'hybrid'"))


def drift_windows(rows: DataFrame, c: Columns, split: int, lasts: tuple[int, ...], seed: int = 0, least: int = 1) -> DataFrame:
    """(last, n_train, n_pos_train, arm, auc, low, high): the arms on the years from ``split`` on, learned on the years before each of ``lasts``."""
    rows = once(rows.filter(F.col(c.year).isNotNull() & F.col(c.label).isNotNull()))
    test, out = rows.filter(F.col(c.year) >= split), None
    for last in lasts:
        train = rows.filter(F.col(c.year) < last)
        found = score_summary(score_table(arms(train, test, c, seed, corrupted=False, least=least)))
        size = train.agg(F.count("*").alias("n_train"), F.sum(F.col(c.label).cast("long")).alias("n_pos_train"))
        part = found.crossJoin(F.broadcast(size)).select(F.lit(last).alias("last"), "n_train", "n_pos_train", "arm", "auc", "low", "high")  # one row of sizes
        out = part if out is None else out.unionByName(part)
    return out


def in_period(rows: DataFrame, c: Columns, split: int, k: int = 5, seed: int = 0, least: int = 1) -> DataFrame:
    """Statistics of the arms out of ``k`` folds of the years before ``split``."""
    known = rows.filter((F.col(c.year) < split) & F.col(c.label).isNotNull())
    dealt, out = once(folds(known, c.label, c.key, k)), None
    for fold in range(k):
        part = arms(dealt.filter(F.col("fold") != fold).drop("fold"), dealt.filter(F.col("fold") == fold).drop("fold"), c, seed, corrupted=False, least=least)
        out = part if out is None else out.unionByName(part)
    return score_summary(score_table(out))
