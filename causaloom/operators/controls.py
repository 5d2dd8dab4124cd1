"""Cases against routine hours: relative risks by zone and their ratio between two groups of cases, with a cluster bootstrap.

A case keeps its own hours when it is redrawn.  All that a redraw needs of a case is its
profile: its group, its own zone and how many of its hours fall into each zone.  Hours
are counted by station, month and hour of the day before they meet the cases, so a
station's month is one row a clock hour and no list of pairs is made; the number of
profiles follows the hours drawn a case, not the cases.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZONES = ("nil", "light", "moderate", "serious")
PROFILE = ["target", "zone", *(f"h{i}" for i in range(len(ZONES)))]


def hour_windows(hours: DataFrame, reach: int = 3) -> DataFrame:
    """(station, month, hour, n0..n3) of ``hours`` (station, month, hour, zone): hours by zone within ``reach`` of each hour of the clock.

    ``hour`` -1 stands for the whole month, which cases without an hour take.
    """
    count = [F.sum((F.col("zone") == z).cast("long")).alias(f"n{i}") for i, z in enumerate(ZONES)]
    by_hour = hours.groupBy("station", "month", "hour").agg(*count)
    add = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(ZONES))]
    near = by_hour.withColumn("hour", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda o: F.pmod(F.col("hour") + o, F.lit(24)).cast("int"))))
    month = by_hour.groupBy("station", "month").agg(*add).select("station", "month", F.lit(-1).alias("hour"), *[f"n{i}" for i in range(len(ZONES))])
    return near.groupBy("station", "month", "hour").agg(*add).unionByName(month)


def case_profiles(cases: DataFrame, windows: DataFrame, most: int = 100, seed: int = 0) -> DataFrame:
    """(target, zone, h0..h3, n): how many cases (case_id, station, month, hour, target, zone) have a profile.

    Of a case's hours ``most`` are drawn without replacement (all, if they are fewer),
    as zone counts and by a generator of its own, so every case weighs alike and reruns agree.
    Cases without hours stay with none.
    """
    counts = [F.coalesce(f"n{i}", F.lit(0)).alias(f"n{i}") for i in range(len(ZONES))]
    met = cases.withColumn("hour", F.coalesce("hour", F.lit(-1))).join(windows, ["station", "month", "hour"], "left")
    met = met.select(F.col("case_id").cast("string").alias("case_id"), F.col("target").cast("int").alias("target"), "zone", *counts)

    def drawn(batches):
        for pdf in batches:
            n = pdf[[f"n{i}" for i in range(len(ZONES))]].to_numpy(np.int64)
            for k in np.flatnonzero(n.sum(axis=1) > most):
                rng = np.random.default_rng([seed, zlib.crc32(pdf.case_id.iat[k].encode())])
                n[k] = rng.multivariate_hypergeometric(n[k], most)
            yield pd.DataFrame({"target": pdf.target, "zone": pdf.zone} | {f"h{i}": n[:, i] for i in range(len(ZONES))})

    return met.mapInPandas(drawn, "target int, zone string, h0 long, h1 long, h2 long, h3 long").groupBy(*PROFILE).agg(F.count("*").alias("n"))


def _risk(own: np.ndarray, hours: np.ndarray) -> np.ndarray:
    """Share of cases by zone over share of hours by zone, for every redraw (row)."""
    share = lambda x: x / np.maximum(x.sum(axis=1, keepdims=True), 1)
    return share(own) / np.maximum(share(hours), 1e-9)


def _sums(pdf: pd.DataFrame, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = np.stack([counts[:, (pdf.zone == z).to_numpy()].sum(axis=1) for z in ZONES], axis=1)
    return own, counts @ pdf[[f"h{i}" for i in range(len(ZONES))]].to_numpy(np.int64)


def zone_ratio(profiles: DataFrame, redraws: int = 2000, seed: int = 1, each: int = 125) -> DataFrame:
    """(zone, cases_1, hours_1, risk_1, cases_0, hours_0, risk_0, ratio, low, high) for cases with and without the target.

    A risk is the share of cases in a zone over the share of their routine hours there, the
    ratio compares both groups.  Its percentile interval of 95 % redraws the cases of either
    group with their hours, ``each`` redraws a task.  A task reads all profiles: with m
    hours a case at most 8 (m + 3 choose 3) of them.
    """
    dealt = profiles.withColumn("first", F.explode(F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), F.lit(redraws - 1), F.lit(each)))))  # -1: the cases as they are

    def risks(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["first"].iat[0])
        pdf = pdf.sort_values(PROFILE)
        rng, rows = np.random.default_rng([seed, first + 1]), {}
        for target in (1, 0):
            own = pdf[pdf.target == target]
            n = own.n.to_numpy(np.int64)
            if first < 0:
                counts = n[None, :]
            else:
                counts = rng.multinomial(n.sum(), n / n.sum(), size=min(each, redraws - first)) if len(n) else np.zeros((min(each, redraws - first), 0), np.int64)
            rows[target] = _sums(own, counts)
        risk = {t: _risk(*rows[t]) for t in rows}
        ratio = risk[1] / np.maximum(risk[0], 1e-9)
        out = []
        for k in range(len(ratio)):
            for i, z in enumerate(ZONES):
                shares = [float(rows[t][j][k, i] / max(1, rows[t][j][k].sum())) for t in (1, 0) for j in (0, 1)]
                out.append((first < 0, z, shares[0], shares[1], float(risk[1][k, i]), shares[2], shares[3], float(risk[0][k, i]), float(ratio[k, i])))
        return pd.DataFrame(out, columns=["point", "zone", "cases_1", "hours_1", "risk_1", "cases_0", "hours_0", "risk_0", "ratio"])

    kinds = "point boolean, zone string, cases_1 double, hours_1 double, risk_1 double, cases_0 double, hours_0 double, risk_0 double, ratio double"
    found = dealt.groupBy("first").applyInPandas(risks, kinds)
    point = lambda c: F.max(F.when(F.col("point"), F.col(c))).alias(c)
    bound = lambda q, name: F.percentile(F.when(~F.col("point"), F.col("ratio")), q).alias(name)
    return found.groupBy("zone").agg(*[point(c) for c in ("cases_1", "hours_1", "risk_1", "cases_0", "hours_0", "risk_0", "ratio")], bound(0.025, "low"), bound(0.975, "high"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of the binomial, by the continued fraction of the incomplete beta function."""
    if k >= n:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    if p <= 0:
        return 1.0
    a, b, x = n - k, k + 1.0, 1.0 - p

    def fraction(a, b, x):
        c, d = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
        h = d
        for m in range(1, 100_000):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
