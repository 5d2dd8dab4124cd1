"""Interventional effects per category from presence patterns: adjustment sets, back-door effects, bootstrap intervals, sensitivity to hidden causes.

Everything is counted from (category, pattern, n, y): distinct sets of factors, comma
separated, with how many records have them and how many of these are severe.  A factor's
cells are the strata of its adjustment set by whether it is present, at most 2^(parents
+ 1); only patterns that hold the factor or one of its set are counted, the rest of a
category is what they leave.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import once


def stable_parents(edges: DataFrame, stability: DataFrame, floor: float = 0.5) -> DataFrame:
    """(category, factor, parent) of the directed edges (category, src, dst) found in at least ``floor`` of the redraws."""
    kept = stability.filter(F.col("stability") >= floor).select("category", "src", "dst")
    return edges.select("category", "src", "dst").join(kept, ["category", "src", "dst"]).select("category", F.col("dst").alias("factor"), F.col("src").alias("parent")).distinct()


def strongest_edges(edges: DataFrame, stability: DataFrame, most: int = 12, floor: float = 0.5) -> DataFrame:
    """The ``most`` edges (category, src, dst, support) of largest support a category among those of at least ``floor`` stability, ties by name."""
    stable = edges.join(stability.filter(F.col("stability") >= floor).select("category", "src", "dst", "stability"), ["category", "src", "dst"])
    rank = F.struct((-F.col("support")).alias("less"), "src", "dst", "support", "stability")
    first = stable.groupBy("category").agg(F.slice(F.sort_array(F.collect_list(rank)), 1, most).alias("edges"))
    return first.select("category", F.posexplode("edges").alias("place", "e")).select("category", (F.col("place") + 1).alias("place"), "e.src", "e.dst", "e.support", "e.stability")


def supports(patterns: DataFrame) -> DataFrame:
    """(category, factor, support)."""
    held = patterns.select("category", "n", F.explode(F.split("pattern", ",")).alias("factor")).filter("factor <> ''")
    return held.groupBy("category", "factor").agg(F.sum("n").alias("support"))


def adjustment_sets(patterns: DataFrame, parents: DataFrame, least: int = 30, most: int = 3) -> DataFrame:
    """(category, factor, adjustment): of every factor of at least ``least`` records its ``most`` parents of largest support, as frequent themselves; ties by name."""
    known = supports(patterns).filter(F.col("support") >= least)
    theirs = parents.select("category", "factor", "parent").distinct().join(known.withColumnRenamed("factor", "parent"), ["category", "parent"])
    sets = theirs.groupBy("category", "factor").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("less"), "parent"))), 1, most)["parent"].alias("adjustment"))
    return known.join(sets, ["category", "factor"], "left").select("category", "factor", F.coalesce("adjustment", F.array().cast("array<string>")).alias("adjustment"))


def effect_cells(patterns: DataFrame, sets: DataFrame) -> DataFrame:
    """(category, factor, z, x, n, y): records and severe ones by the present parents of the set and whether the factor is present."""
    of_category = sets.groupBy("category").agg(F.collect_list(F.struct("factor", "adjustment")).alias("sets"))
    items = patterns.select("category", F.split("pattern", ",").alias("items"), "n", "y").join(of_category, "category")
    seen = F.transform("sets", lambda s: F.struct(s["factor"].alias("factor"), F.array_join(F.filter(s["adjustment"], lambda a: F.array_contains("items", a)), "|").alias("z"), F.array_contains("items", s["factor"]).cast("int").alias("x")))
    touched = items.select("category", "n", "y", F.explode(F.filter(seen, lambda c: (c["x"] == 1) | (c["z"] != ""))).alias("c")).select("category", "c.*", "n", "y")
    cells = touched.groupBy("category", "factor", "z", "x").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    whole = patterns.groupBy("category").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    held = sets.select("category", "factor").join(whole, "category").union(cells.select("category", "factor", (-F.col("n")).alias("n"), (-F.col("y")).alias("y")))
    rest = held.groupBy("category", "factor").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).filter("n > 0")
    return cells.select("category", "factor", "z", "x", "n", "y").unionByName(rest.select("category", "factor", F.lit("").alias("z"), F.lit(0).alias("x"), "n", "y"))


def adjusted_effects(cells: DataFrame, sets: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(category, factor, adjustment, n, n_present, crude, p0, p1, adjusted): risks under do(absent) and do(present).

    Risks are smoothed by ``alpha``.  A stratum without an arm takes its pooled risk; without
    an adjustment set an empty arm takes the category's plain risk.  The crude contrast is
    null without an arm.
    """
    one = lambda c, x: F.coalesce(F.sum(F.when(F.col("x") == x, F.col(c))), F.lit(0))
    strata = cells.groupBy("category", "factor", "z").agg(one("n", 1).alias("n1"), one("y", 1).alias("y1"), one("n", 0).alias("n0"), one("y", 0).alias("y0"))
    risk = lambda y, n: F.try_divide(y + alpha, n + 2 * alpha)
    nz, yz = F.col("n1") + F.col("n0"), F.col("y1") + F.col("y0")
    arm = lambda x: F.sum(nz * F.when(F.col(f"n{x}") > 0, risk(F.col(f"y{x}"), F.col(f"n{x}"))).otherwise(risk(yz, nz))) / F.sum(nz)
    total = [F.sum(c).alias(c) for c in ("n1", "y1", "n0", "y0")]
    done = strata.groupBy("category", "factor").agg(*total, arm(0).alias("a0"), arm(1).alias("a1")).join(sets, ["category", "factor"])
    n = F.col("n1") + F.col("n0")
    plain = lambda x: F.when((F.size("adjustment") == 0) & (F.col(f"n{x}") == 0), (F.col("y1") + F.col("y0")) / n).otherwise(F.col(f"a{x}"))
    crude = F.when((F.col("n1") > 0) & (F.col("n0") > 0), risk(F.col("y1"), F.col("n1")) - risk(F.col("y0"), F.col("n0")))
    out = done.select("category", "factor", "adjustment", n.alias("n"), F.col("n1").alias("n_present"), crude.alias("crude"), plain(0).alias("p0"), plain(1).alias("p1"))
    return out.withColumn("adjusted", F.col("p1") - F.col("p0")).withColumn("shift", F.col("crude") - F.col("adjusted"))


def _effects(n: np.ndarray, y: np.ndarray, z: np.ndarray, x: np.ndarray, adjusted: bool, alpha: float) -> np.ndarray:
    """Adjusted effects of many redraws: ``n`` and ``y`` (redraws, cells)."""
    out = np.zeros((2, len(n)))
    whole = n.sum(axis=1)
    for stratum in np.unique(z):
        own = z == stratum
        nz, yz = n[:, own].sum(axis=1), y[:, own].sum(axis=1)
        for arm in (0, 1):
            cell = own & (x == arm)
            na, ya = n[:, cell].sum(axis=1), y[:, cell].sum(axis=1)
            empty = (yz + alpha) / (nz + 2 * alpha) if adjusted else yz / whole
            out[arm] += nz / whole * np.where(na > 0, (ya + alpha) / (na + 2 * alpha), empty)
    return out[1] - out[0]


def bootstrap_effects(cells: DataFrame, sets: DataFrame, redraws: int = 400, seed: int = 0, alpha: float = 1.0, each: int = 50) -> DataFrame:
    """(category, factor, low, high): percentile interval of 95 % of the adjusted effect over redraws of the category's records.

    Redrawing records with replacement redraws a factor's cells as a multinomial, so a
    redraw costs its at most 2^(parents + 2) cells whatever the number of records.
    Redraws are dealt ``each`` a task; numbers depend on category, factor and redraw only.
    """
    packed = cells.groupBy("category", "factor").agg(F.sort_array(F.collect_list(F.struct("z", "x", "n", "y"))).alias("cells")).join(sets.select("category", "factor", (F.size("adjustment") > 0).alias("adjusted")), ["category", "factor"])
    dealt = packed.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(redraws - 1), F.lit(each))))
    dealt = dealt.repartition("category", "factor", "first")

    def drawn(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                z, x = np.array([c["z"] for c in r.cells], object), np.array([c["x"] for c in r.cells])
                severe = np.array([c["y"] for c in r.cells], np.int64)
                counts = np.concatenate([severe, np.array([c["n"] for c in r.cells], np.int64) - severe])
                rng = np.random.default_rng([seed, zlib.crc32(f"{r.category}\t{r.factor}".encode()), r.first])
                got = rng.multinomial(counts.sum(), counts / counts.sum(), size=min(each, redraws - r.first))
                y, n = got[:, : len(z)], got[:, : len(z)] + got[:, len(z) :]
                rows += [(r.category, r.factor, float(e)) for e in _effects(n, y, z.astype(str), x, r.adjusted, alpha)]
            yield pd.DataFrame(rows, columns=["category", "factor", "effect"])

    found = dealt.mapInPandas(drawn, "category string, factor string, effect double")
    return found.groupBy("category", "factor").agg(F.percentile("effect", 0.025).alias("low"), F.percentile("effect", 0.975).alias("high"))


def interventions(patterns: DataFrame, parents: DataFrame, least: int = 30, most: int = 3, redraws: int = 400) -> DataFrame:
    """Adjusted and crude effects of every frequent factor with their interval and place in the category, strongest first, ties by name."""
    sets = once(adjustment_sets(patterns, parents, least, most))
    cells = once(effect_cells(patterns, sets))
    found = adjusted_effects(cells, sets).join(bootstrap_effects(cells, sets, redraws), ["category", "factor"], "left")
    ranked = found.groupBy("category").agg(F.sort_array(F.collect_list(F.struct((-F.col("adjusted")).alias("less"), F.struct(*found.columns).alias("r")))).alias("all"))
    return ranked.select(F.posexplode("all").alias("place", "e")).select("e.r.*", (F.col("place") + 1).alias("place"))


def e_value(ratio):
    """Least association that a hidden cause needs with factor and outcome to explain a risk ratio away."""
    r = F.when(ratio < 1, F.try_divide(F.lit(1.0), ratio)).otherwise(ratio)
    return r + F.sqrt(r * (r - 1))


def hidden_cause_check(patterns: DataFrame, effects: DataFrame, relations: DataFrame) -> DataFrame:
    """The adjusted effects of factors with an adjustment set against a graph that allows hidden causes.

    ``effects`` is what :func:`interventions` gives, ``relations`` (category, factor, other,
    relation) what a partial ancestral graph says.  Each member of a set is named with its
    relation (absent without an edge); the effect is recomputed on the certain and on the
    certain and possible parents, ``confounded`` says whether a member shares a hidden cause with
    the factor.  E-values are for the risk ratio and for the interval's bound next to no
    effect (1 if the interval holds no effect).
    """
    some = effects.filter(F.size("adjustment") > 0).select("category", "factor", "adjustment", "crude", "adjusted", "p0", "p1", "low", "high")
    members = some.select("category", "factor", F.explode("adjustment").alias("other")).join(relations, ["category", "factor", "other"], "left").withColumn("relation", F.coalesce("relation", F.lit("absent")))
    said = members.groupBy("category", "factor").agg(
        F.sort_array(F.collect_list(F.concat_ws(":", "other", "relation"))).alias("relations"), F.max(F.col("relation") == "confounded").alias("confounded"),
        F.sort_array(F.collect_list(F.when(F.col("relation") == "parent", F.col("other")))).alias("definite"),
        F.sort_array(F.collect_list(F.when(F.col("relation").isin("parent", "possible parent"), F.col("other")))).alias("possible"),
    )
    out = some.join(said, ["category", "factor"])
    for name in ("definite", "possible"):
        sets = said.select("category", "factor", F.col(name).alias("adjustment"))
        out = out.join(adjusted_effects(effect_cells(patterns, sets), sets).select("category", "factor", F.col("adjusted").alias(f"adjusted_{name}")), ["category", "factor"])
    ratio, bound = F.try_divide("p1", "p0"), F.try_divide(F.col("p0") + F.when(F.col("adjusted") > 0, F.col("low")).otherwise(F.col("high")), F.col("p0"))
    return out.withColumn("risk_ratio", ratio).withColumn("e_value", e_value(ratio)).withColumn("e_value_bound", F.when((bound - 1) * F.col("adjusted") > 0, e_value(bound)).otherwise(F.lit(1.0)))
