"""How results of the icing model depend on its two constants: the cooling at the throttle plate and the exposure.

Records are counted by weather and label first, which is recorded in whole degrees; all cells
of the grid score those points, and one pass of rank statistics serves all cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics_sql as px
from .ranking import counted_table, score_summary

# The scales of the study, and its worked case in degrees Celsius.
SCALES = (0.75, 0.9, 1.0, 1.1, 1.25)
CASE = {"t": 13.0, "td": 12.0, "heat": 30.0, "dry": -5.0}


def _pressure(t: Column) -> Column:
    return F.expr("6.112E0") * F.exp(F.expr("17.62E0") * t / (F.expr("243.12E0") + t))


def icing_probability(t: Column, td: Column, cooling: Column, exposure: Column) -> Column:
    """Probability of ice by weather and both constants."""
    throat = t - cooling
    water = F.greatest(F.lit(0.0), _pressure(F.least(td, t, F.lit(0.0))) - _pressure(throat))
    return F.when(throat < 0, 1 - F.exp(-exposure * water)).otherwise(F.lit(0.0))


def icing_grid(rows: DataFrame, t: str, td: str, y: str, cells: list[tuple[float, float]], power: str = "descent", engine: float = px.P_ENGINE_GIVEN_ICE, case: dict[str, float] = CASE) -> DataFrame:
    """A row a cell (cooling_scale, exposure_scale): n, n_pos, cooling, exposure, auc, p_ice, risk, risk_heat, risk_dry and ranking_preserved.

    The risks are those of the worked case with the engine's failure, as it is, with heat at the
    carburetor and in dry air; the ranking holds if heat is the least and the case as it is the
    most.  Records without weather or label do not count; with one label only, or none,
    the auc is null.  Weather that is not a number counts as null.
    """
    spark = rows.sparkSession
    scales = spark.createDataFrame([(f"{a!r}:{b!r}", float(a), float(b), px.COOLING[power] * a, px.K_EXPOSURE * b) for a, b in dict.fromkeys(cells)], "cell string, cooling_scale double, exposure_scale double, cooling double, exposure double")
    usable = F.col(t).isNotNull() & F.col(td).isNotNull() & ~F.isnan(F.col(t).cast("double")) & ~F.isnan(F.col(td).cast("double")) & F.col(y).isNotNull()
    label = F.col(y).cast("int")
    points = rows.filter(usable).groupBy(F.col(t).cast("double").alias("_t"), F.col(td).cast("double").alias("_td")).agg(F.sum((label == 1).cast("long")).alias("p"), F.sum((label == 0).cast("long")).alias("n"))
    scored = points.crossJoin(F.broadcast(scales)).withColumn("score", icing_probability(F.col("_t"), F.col("_td"), F.col("cooling"), F.col("exposure")))  # a row a cell
    counts = scored.groupBy("cell", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    found = score_summary(counted_table(counts, "cell"), "cell").select("cell", "n_pos", (F.col("n_pos") + F.col("n_neg")).alias("n"), "auc")
    at = lambda x, dew: icing_probability(F.lit(x), F.lit(dew), F.col("cooling"), F.col("exposure"))
    base, heat, dry = at(case["t"], case["td"]), at(case["t"] + case["heat"], case["td"]), at(case["t"], case["dry"])
    worked = scales.select("*", base.alias("p_ice"), (base * engine).alias("risk"), (heat * engine).alias("risk_heat"), (dry * engine).alias("risk_dry"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_pos")]
    return worked.join(F.broadcast(found), "cell", "left").select("cooling_scale", "exposure_scale", *zero, "cooling", "exposure", "auc", "p_ice", "risk", "risk_heat", "risk_dry", ((F.col("risk_heat") < F.col("risk_dry")) & (F.col("risk_dry") < F.col("risk"))).alias("ranking_preserved"))


def summary(grid: DataFrame) -> DataFrame:
    """One row: the range of the auc along each constant with the other one as it is, whether exposure leaves it alone, and whether the ranking holds in all cells."""
    cooling, exposure = F.when(F.col("exposure_scale") == 1, F.col("auc")), F.when(F.col("cooling_scale") == 1, F.col("auc"))
    return grid.agg(
        F.min(cooling).alias("auc_min_cooling"), F.max(cooling).alias("auc_max_cooling"), F.min(exposure).alias("auc_min_exposure"), F.max(exposure).alias("auc_max_exposure"),
        (F.max(exposure) - F.min(exposure) < 1e-9).alias("auc_invariant_to_exposure"), F.every("ranking_preserved").alias("ranking_preserved_everywhere"),
    )
