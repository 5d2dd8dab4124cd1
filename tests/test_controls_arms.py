"""Zone ratios against a plain bootstrap; arms of the monitor against their definitions."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causaloom.operators import arms, controls
from causaloom.operators.controls import ZONES

CASES, HOURS = "case_id string, station long, month int, hour int, target int, zone string", "station long, month int, hour int, zone string"


def study(n=300, stations=20, seed=1):
    r = random.Random(seed)
    hours = [(s, m, r.randrange(24), r.choices(ZONES, (4, 3, 2, 1))[0]) for s in range(stations) for m in (1, 2) for _ in range(60)]
    cases = [(f"c{k}", r.randrange(stations + 1), r.choice((1, 2)), r.choice([None, *range(24)]), int(k % 3 == 0), r.choices(ZONES, (2, 3, 3, 3) if k % 3 == 0 else (4, 3, 2, 1))[0]) for k in range(n)]
    return cases, hours


def near(case, hours, reach=3):
    _, s, m, h, _, _ = case
    return [z for a, b, c, z in hours if (a, b) == (s, m) and (h is None or min(abs(c - h), 24 - abs(c - h)) <= reach)]


def test_profiles_and_ratio_against_a_plain_bootstrap(spark):
    cases, hours = study()
    windows = controls.hour_windows(spark.createDataFrame(hours, HOURS))
    profiles = controls.case_profiles(spark.createDataFrame(cases, CASES), windows, most=1000)
    got = collections.Counter()
    for r in profiles.collect():
        got[r.target, r.zone, r.h0, r.h1, r.h2, r.h3] += r.n
    mine = [(c[4], c[5], *(near(c, hours).count(z) for z in ZONES)) for c in cases]
    assert got == collections.Counter(mine) and any(sum(m[2:]) == 0 for m in mine)

    def ratio(rows):
        risk = {}
        for t in (1, 0):
            own = [m for m in rows if m[0] == t]
            every = np.sum([m[2:] for m in own], axis=0)
            risk[t] = np.array([sum(m[1] == z for m in own) / len(own) for z in ZONES]) / np.maximum(every / every.sum(), 1e-9)
        return risk, risk[1] / np.maximum(risk[0], 1e-9)

    found = {r.zone: r for r in controls.zone_ratio(profiles, redraws=1000, each=100).collect()}
    risk, point = ratio(mine)
    rng, redrawn = np.random.default_rng(3), []
    groups = {t: [m for m in mine if m[0] == t] for t in (1, 0)}
    for _ in range(500):
        redrawn.append(ratio([g[i] for g in groups.values() for i in rng.integers(0, len(g), len(g))])[1])
    low, high = np.percentile(redrawn, [2.5, 97.5], axis=0)
    for i, z in enumerate(ZONES):
        r = found[z]
        assert (r.risk_1, r.risk_0, r.ratio) == pytest.approx((risk[1][i], risk[0][i], point[i]))
        assert r.cases_1 == pytest.approx(sum(m[1] == z for m in groups[1]) / len(groups[1]))
        assert (math.log(r.low), math.log(r.high)) == pytest.approx((math.log(low[i]), math.log(high[i])), abs=0.12)
    again = {r.zone: r for r in controls.zone_ratio(profiles.repartition(7), redraws=1000, each=100).collect()}
    assert again == found


def test_drawn_hours_are_as_many_and_fair(spark):
    hours = [(1, 1, k % 24, ZONES[min(3, k % 10)]) for k in range(600)]
    cases = [(f"c{k}", 1, 1, None, 1, "nil") for k in range(400)]
    rows = controls.case_profiles(spark.createDataFrame(cases, CASES), controls.hour_windows(spark.createDataFrame(hours, HOURS)), most=100).collect()
    assert all(r.h0 + r.h1 + r.h2 + r.h3 == 100 for r in rows) and sum(r.n for r in rows) == 400 and len(rows) > 50
    assert [sum(r[f"h{i}"] * r.n for r in rows) / 400 for i in range(4)] == pytest.approx([10, 10, 10, 70], abs=0.6)


def test_no_cases(spark):
    windows = controls.hour_windows(spark.createDataFrame([], HOURS))
    assert controls.zone_ratio(controls.case_profiles(spark.createDataFrame([], CASES), windows)).count() == 0
    only = controls.case_profiles(spark.createDataFrame([("a", 1, 1, 5, 1, "nil")], CASES), windows)
    assert {r.zone: (r.cases_1, r.hours_1) for r in controls.zone_ratio(only, redraws=10).collect()} == {"nil": (1, 0), "light": (0, 0), "moderate": (0, 0), "serious": (0, 0)}


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 40, 0.1), (20, 40, 0.5), (39, 40, 0.97), (40, 40, 0.2), (5, 1000, 0.01), (-1, 5, 0.5), (2, 5, 0.0), (2, 5, 1.0)])
def test_binomial_tail(k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert controls.binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9, abs=1e-15)


TRANSITIONS = "guard string, phase string, t_c double, td_c double, wind_kts double, dens_alt_ft double"


def test_arms(spark):
    r = random.Random(4)
    one = lambda: (r.choice(["carb_icing", "gust_stall", "shear_stall", "gust_overload", "fuel_exhaustion", None]), r.choice(["landing", "cruise", "approach", None]), *(r.choice([None, (t := r.uniform(-20, 35)), t]) and (t, t - r.uniform(0, 25)) or (None, None)), r.choice([None, r.uniform(0, 60)]), None)
    rows = [one() for _ in range(600)]
    transitions = spark.createDataFrame(rows, TRANSITIONS)
    members = spark.createDataFrame([(10.0, 9.9, None, None)] * 30 + [(None, None, 100.0, None)] * 10 + [(None, None, None, 500.0)] * 60, "t_c double, td_c double, wind_kts double, dens_alt_ft double")
    table = {(x.arm, x.guard): x for x in arms.monitor_arms(transitions, members).collect()}
    low = set(arms.LOW_PHASES)
    can = collections.Counter(g for g, p, t, td, w, _ in rows if (g == "carb_icing" and t is not None) or (g in ("gust_stall", "shear_stall", "gust_overload") and w is not None and p in low))
    plain = transitions.filter(arms.checkable())
    violated = {x.guard: x.v for x in plain.groupBy("guard").agg(F.sum((F.expr(arms.availability()) < 1e-9).cast("long")).alias("v")).collect()}
    for g, n in can.items():
        assert table["true", g].n_checkable == table["negate", g].n_checkable == n and table["true", g].violations == violated[g]
        # all foreign weather is icing weather and all foreign wind 100 kt: nothing is violated
        assert table["population", g].violations == 0 and table["population", g].n_checkable <= n
        assert table["true", g].p_value == pytest.approx(controls.binomial_cdf(violated[g], n, 0.0)) and table["negate", g].p_value is None
        assert table["permute", g].n_checkable <= n
    assert table["population", "carb_icing"].n_checkable == can["carb_icing"]  # 0.7 ^ 50 of them would draw nobody
    assert table["true", "all"].n_checkable == sum(can.values()) and 0 < table["permute", "all"].n_checkable < sum(can.values())


def test_population_draws_are_fair_and_may_fail(spark):
    work = spark.createDataFrame([("carb_icing", None, 0.0, 0.0, None, None, k) for k in range(1, 4001)], TRANSITIONS + ", _row long")
    members = spark.createDataFrame([(float(k), float(k), None, None) for k in range(4)] + [(None, None, 1.0, None)] * 96, "t_c double, td_c double, wind_kts double, dens_alt_ft double")
    got = arms.population_drivers(work, members, tries=20)
    counts = {x.t_c: x["count"] for x in got.groupBy("t_c").count().collect()}
    share = 1 - 0.96**20
    assert set(counts) == {0.0, 1.0, 2.0, 3.0} and sum(counts.values()) == pytest.approx(4000 * share, abs=130)
    assert all(n == pytest.approx(1000 * share, abs=110) for n in counts.values())
    nobody = arms.population_drivers(work, members.filter("wind_kts > 1"), tries=20)
    assert nobody.count() == 0


def test_nothing_to_check(spark):
    none = spark.createDataFrame([], TRANSITIONS)
    assert arms.monitor_arms(none, none.select(*arms.DRIVERS)).count() == 0
