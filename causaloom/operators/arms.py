"""Null arms of the admissibility monitor: transitions with their own, permuted, foreign and sign-turned drivers.

A transition (guard, phase) is judged by the drivers that it is paired with; the arms
pair it differently and keep everything else.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physics_sql as px
from .controls import binomial_cdf
from .shared import once
from .stats import numbered

DRIVERS = ["t_c", "td_c", "wind_kts", "dens_alt_ft"]
LOW_PHASES = ("takeoff", "initial_climb", "go_around", "approach", "final_approach", "landing")
#: What a guard needs to be checkable: temperature and dew point, or wind (and a low phase of the transition's own).
NEEDS = {"carb_icing": "t_c IS NOT NULL AND td_c IS NOT NULL", "gust_stall": "wind_kts IS NOT NULL", "shear_stall": "wind_kts IS NOT NULL", "gust_overload": "wind_kts IS NOT NULL"}


def checkable() -> str:
    low = ", ".join(f"'{p}'" for p in LOW_PHASES)
    whens = " ".join(f"WHEN '{g}' THEN {need}" + ("" if g == "carb_icing" else f" AND coalesce(phase, '') IN ({low})") for g, need in NEEDS.items())
    return f"CASE guard {whens} ELSE false END"


def availability(turned: bool = False) -> str:
    """How available a guard's transition is under its drivers; with the margins' signs turned for the corrupted arm."""
    margins = ", ".join(px.icing_margin("t_c", "td_c", p) for p in px.COOLING)
    gust = px.p_exceed_dryden(px.stall_gust(px.f(px.APPROACH_KT)), "wind_kts", px.f(px.APPROACH_KT * px.KT_TO_FPS))
    over = px.p_exceed_dryden(f"({px.f(1.5 * px.N_LIMIT - 1)} / {px.pratt(px.f(px.VC_KT))})", "wind_kts", px.f(px.VC_KT * px.KT_TO_FPS))
    need = px.f(px.APPROACH_KT - px.VS_KT)
    if turned:
        return f"CASE guard WHEN 'carb_icing' THEN CASE WHEN least({margins}) <= 0 THEN 1E0 ELSE 0E0 END WHEN 'gust_stall' THEN 1E0 - {gust} WHEN 'shear_stall' THEN CASE WHEN wind_kts - {need} <= 0 THEN 1E0 ELSE 0E0 END WHEN 'gust_overload' THEN 1E0 - {over} END"
    return f"CASE guard WHEN 'carb_icing' THEN CASE WHEN greatest({margins}) >= 0 THEN 1E0 ELSE 0E0 END WHEN 'gust_stall' THEN {gust} WHEN 'shear_stall' THEN CASE WHEN wind_kts - {need} >= 0 THEN 1E0 ELSE 0E0 END WHEN 'gust_overload' THEN {over} END"


def population_drivers(work: DataFrame, population: DataFrame, tries: int = 50, seed: int = 7) -> DataFrame:
    """``work`` with the drivers of a member of ``population`` drawn with replacement, at most ``tries`` times until the guard can be checked.

    The first checkable of uniform draws is uniform among the checkable members, and none
    comes in ``tries`` with (1 - their share) ^ tries.  So members are numbered by what
    they record, a transition draws one number, and one join by (kind, number) fetches the
    drivers, whatever the sizes; transitions that draw none leave the arm.
    """
    kinds = {"weather": "t_c IS NOT NULL AND td_c IS NOT NULL", "wind": "wind_kts IS NOT NULL"}
    members = once(population.select(*DRIVERS))
    whole = members.count()
    key = F.xxhash64(F.lit(seed), "guard", "phase", "_row")
    luck = (F.pmod(F.xxhash64(key, F.lit("luck")), F.lit(1 << 53)) / float(1 << 53)).alias("luck")
    rows = work.drop(*DRIVERS).withColumn("_kind", F.when(F.col("guard") == "carb_icing", F.lit("weather")).otherwise(F.lit("wind")))
    out = None
    for kind, condition in kinds.items():
        some = numbered(members.filter(condition), seed)
        n = some.count()
        own = rows.filter(F.col("_kind") == kind)
        if n == 0:
            own = own.limit(0)
        missed = (1 - n / max(1, whole)) ** tries
        drawn = own.filter(luck >= missed).withColumn("_member", F.pmod(key, F.lit(max(1, n))) + 1)
        got = drawn.join(some.withColumnRenamed("_row", "_member"), "_member").drop("_member", "_kind")
        out = got if out is None else out.unionByName(got)
    return out


def monitor_arms(transitions: DataFrame, population: DataFrame, tries: int = 50, eps: float = 1e-9, seed: int = 7) -> DataFrame:
    """(arm, guard, n_checkable, violations, rate, p_value) of the arms true, negate, permute and population, by guard and together.

    ``transitions`` (guard, phase and drivers) that cannot be checked take no part.  Permute
    deals the drivers of these transitions to each other, population draws them from
    ``population`` (drivers, one row a recorded case).  ``p_value`` of the true arm: chance
    of as few violations at the population's rate.
    """
    work = numbered(transitions.select("guard", "phase", *DRIVERS).filter(checkable()), seed)
    others = numbered(work.select(*DRIVERS), seed + 1)
    judged = F.expr(availability()) < eps
    arms = [
        ("true", work, judged), ("negate", work, F.expr(availability(turned=True)) < eps),
        ("permute", work.drop(*DRIVERS).join(others, "_row").filter(checkable()), judged),
        ("population", population_drivers(work, population, tries, seed + 2), judged),
    ]
    rows = None
    for name, pairs, violated in arms:
        counts = pairs.groupBy("guard").agg(F.lit(name).alias("arm"), F.count("*").alias("n_checkable"), F.sum(F.coalesce(violated, F.lit(False)).cast("long")).alias("violations"))
        rows = counts if rows is None else rows.unionByName(counts)
    rows = once(rows)  # guards x arms
    rows = rows.unionByName(rows.groupBy("arm").agg(F.lit("all").alias("guard"), F.sum("n_checkable").alias("n_checkable"), F.sum("violations").alias("violations")))
    rows = rows.withColumn("rate", F.col("violations") / F.col("n_checkable"))
    against = rows.filter("arm = 'population'").select("guard", F.col("rate").alias("null_rate"))

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(q) else binomial_cdf(int(a), int(b), float(q)) for a, b, q in zip(k, n, p, strict=True)], dtype="float64")

    found = rows.join(F.broadcast(against), "guard", "left")
    return found.select("arm", "guard", "n_checkable", "violations", "rate", F.when(F.col("arm") == "true", tail("violations", "n_checkable", "null_rate")).alias("p_value"))
