"""Rank statistics against all pairs, encoders and arms against planted effects."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causaloom.operators import heldout, ranking, stats


def scored(spark, seed=1, n=400, tied=True):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        y, base = int(r.random() < 0.3), r.random()
        for arm, gain in (("a", 0.4), ("b", 0.1)):
            p = base + gain * y + 0.3 * r.random()
            rows.append((arm, k, y, round(p, 1) if tied else p))
    return rows, spark.createDataFrame(rows, "arm string, id long, y int, p double").repartition(6)


def parts(rows, arm):
    """DeLong's components of every record, pair by pair."""
    own = [(i, y, p) for a, i, y, p in rows if a == arm]
    pos, neg = [p for _, y, p in own if y], [p for _, y, p in own if not y]
    rank = lambda a, b: (a > b) + (a == b) / 2
    return {i: np.mean([rank(p, q) for q in neg]) if y else np.mean([rank(q, p) for q in pos]) for i, y, p in own}, {i: y for i, y, _ in own}


def test_summary_and_paired_difference_against_all_pairs(spark):
    rows, df = scored(spark)
    table = ranking.score_table(df)
    got = {r.arm: r for r in ranking.score_summary(table).collect()}
    components = {}
    for arm in "ab":
        v, y = components[arm] = parts(rows, arm)
        v10, v01 = (np.array([v[i] for i in v if y[i] == t]) for t in (1, 0))
        half = 1.96 * math.sqrt(v10.var(ddof=1) / len(v10) + v01.var(ddof=1) / len(v01))
        assert (got[arm].auc, got[arm].low, got[arm].high) == pytest.approx((v10.mean(), v10.mean() - half, v10.mean() + half))
        own = [(p, t) for a, _, t, p in rows if a == arm]
        assert got[arm].brier == pytest.approx(np.mean([(min(1, max(0, p)) - t) ** 2 for p, t in own]))
        cuts = sorted({p for p, _ in own}, reverse=True)
        recall, ap = 0.0, 0.0
        for c in cuts:
            above = [t for p, t in own if p >= c]
            ap += (sum(above) / len(v10) - recall) * sum(above) / len(above)
            recall = sum(above) / len(v10)
        assert got[arm].average_precision == pytest.approx(ap)
    (va, y), (vb, _) = components["a"], components["b"]
    d = {t: np.array([va[i] - vb[i] for i in va if y[i] == t]) for t in (1, 0)}
    r = ranking.paired_difference(df, table, "a", "b", "id").first()
    z = d[1].mean() / math.sqrt(d[1].var(ddof=1) / len(d[1]) + d[0].var(ddof=1) / len(d[0]))
    assert (r.difference, r.z, r.p_two_sided) == pytest.approx((d[1].mean(), z, math.erfc(abs(z) / math.sqrt(2))))
    assert d[1].mean() == pytest.approx(got["a"].auc - got["b"].auc) == pytest.approx(d[0].mean())


@pytest.mark.parametrize("tied", [True, False])
def test_reliability_is_by_quantiles(spark, tied):
    rows, df = scored(spark, seed=3, tied=tied)
    got = {(r.arm, r.bin): r for r in ranking.reliability(ranking.score_table(df)).collect()}
    for arm in "ab":
        own = pd.DataFrame([(p, y) for a, _, y, p in rows if a == arm], columns=["p", "y"])
        own["bin"] = pd.qcut(own.p, 10, labels=False, duplicates="drop")
        want = own.groupby("bin").agg(p_mean=("p", "mean"), y_rate=("y", "mean"), n=("p", "size"))
        assert sorted(b for a, b in got if a == arm) == sorted(want.index)
        for b, r in want.iterrows():
            assert (got[arm, b].p_mean, got[arm, b].y_rate, got[arm, b].n) == pytest.approx((r.p_mean, r.y_rate, r.n))


def test_statistics_without_a_class(spark):
    one = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 2, 1, 0.7), ("b", 1, 1, 0.2), ("b", 2, 0, 0.1)], "arm string, id long, y int, p double")
    got = {r.arm: r for r in ranking.score_summary(ranking.score_table(one)).collect()}
    assert got["a"].auc is None and got["a"].n_neg == 0 and got["b"].auc == 1.0 and got["b"].low is None
    assert ranking.score_summary(ranking.score_table(one.limit(0))).count() == 0


def test_cumulated_over_many_tasks(spark):
    rows = [(g, i, (i * 7) % 5) for g in "xyz" for i in range(500)]
    got = ranking.cumulated(spark.createDataFrame(rows, "g string, i long, v long").repartition(9), "g", "i", ["v"]).collect()
    assert len(got) == 1500 and all(r.v_before == sum((k * 7) % 5 for k in range(r.i)) for r in got)


def test_encoder_learns_frequent_values_of_the_training_rows(spark):
    train = spark.createDataFrame([("a", "x", 1.0)] * 30 + [("b", "x", 2.0)] * 29 + [(None, "y", 3.0)] * 30, "c string, d string, v double")
    test = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0), (None, "x", 3.0), ("never", "x", 2.0)], "c string, d string, v double")
    made = heldout.encoder(["c", "d"], ["v"], least=30).fit(heldout.with_values(train, ["c", "d"]))
    words = made.stages[0].vocabulary
    assert sorted(words) == ["c=UNK", "c=a", "d=x", "d=y"]
    rows = made.transform(heldout.with_values(test, ["c", "d"])).collect()
    hot = [{w for w, v in zip(words, r.features.toArray(), strict=False) if v} for r in rows]
    assert hot == [{"c=a", "d=x"}, {"d=y"}, {"c=UNK", "d=x"}, {"d=x"}]
    mean, sd = (30 + 58 + 90) / 89, np.std([1.0] * 30 + [2.0] * 29 + [3.0] * 30, ddof=1)
    assert [r.features.toArray()[-1] for r in rows] == pytest.approx([(x - mean) / sd for x in (1, 2, 3, 2)])


def test_folds_are_stratified(spark):
    rows = spark.createDataFrame([(k, int(k % 7 == 0)) for k in range(700)] + [(900, None)], "id long, y int")
    got = stats.folds(rows, "y", "id").groupBy("fold", "y").count().collect()
    assert sorted((r.fold, r.y, r["count"]) for r in got) == [(f, y, n) for f in range(5) for y, n in ((0, 120), (1, 20))]
    again = stats.folds(rows.repartition(5), "y", "id")
    assert {(r.id, r.fold) for r in again.collect()} == {(r.id, r.fold) for r in stats.folds(rows, "y", "id").collect()}


def planted(spark, n=3000):
    """The margin and a category raise the chance; before 2000 the margin does not."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(n):
        year, margin, group = int(rng.integers(1990, 2010)), float(rng.normal()), "uvw"[int(rng.integers(3))]
        p = 1 / (1 + math.exp(-(-1.5 + (1.6 * margin if year >= 1995 else 0) + (2.0 if group == "u" else 0))))
        rows.append((f"r{k}", year, int(rng.random() < p), group, margin, 1 / (1 + math.exp(-margin)), float(rng.normal())))
    return spark.createDataFrame(rows + [("none", None, 1, "u", 0.0, 0.5, 0.0), ("nolabel", 2005, None, "u", 0.0, 0.5, 0.0)], "record_id string, year int, y int, grp string, margin double, chart double, other double")


def test_arms_on_later_years(spark):
    rows, c = planted(spark), heldout.Columns(categories=["grp"], weather=["other"])
    table, pairs, bins = heldout.time_split(rows, c, 2002)
    got = {r.arm: r for r in table.collect()}
    n = rows.filter("year >= 2002 AND y IS NOT NULL").count()
    assert set(got) == {"physics", "physics_calibrated", "corpus", "raw_weather", "hybrid", "hybrid_inverted", "hybrid_permuted"} and all(r.n_pos + r.n_neg == n for r in got.values())
    # the margin ranks as the chart does; with the category it is better; dealt margins say nothing
    assert got["physics_calibrated"].auc == pytest.approx(got["physics"].auc, abs=0.03) and got["hybrid"].auc > got["physics"].auc + 0.01 > got["corpus"].auc + 0.1
    assert got["raw_weather"].auc == pytest.approx(got["corpus"].auc, abs=0.03)
    assert got["hybrid_permuted"].auc == pytest.approx(got["corpus"].auc, abs=0.04)
    assert got["hybrid_inverted"].auc < got["hybrid"].auc - 0.1  # an increasing fit cannot use a turned margin
    assert got["hybrid"].brier < got["corpus"].brier and got["hybrid"].average_precision > got["corpus"].average_precision
    signs = {(r.first, r.second): r for r in pairs.collect()}
    assert signs["hybrid", "corpus"].z > 5 and signs["raw_weather", "hybrid"].z < -5 and signs["raw_weather", "hybrid"].difference == pytest.approx(got["raw_weather"].auc - got["hybrid"].auc)
    assert sum(r.n for r in bins.collect()) == n and all(abs(r.p_mean - r.y_rate) < 0.15 for r in bins.collect())


def test_windows_and_folds_of_training_years(spark):
    rows, c = planted(spark, 1500), heldout.Columns(categories=["grp"], weather=["other"])
    found = {(r["last"], r.arm): r for r in heldout.drift_windows(rows, c, 2002, (1995, 2002)).collect()}
    assert found[1995, "hybrid"].n_train == rows.filter("year < 1995").count() and found[2002, "hybrid"].n_pos_train == rows.filter("year < 2002 AND y = 1").count()
    assert found[2002, "hybrid"].auc > found[1995, "hybrid"].auc + 0.03 and found[1995, "physics"].auc == found[2002, "physics"].auc
    inside = {r.arm: r for r in heldout.in_period(rows, c, 2002, k=3).collect()}
    assert all(r.n_pos + r.n_neg == rows.filter("year < 2002").count() for r in inside.values()) and inside["hybrid"].auc > inside["corpus"].auc


def test_no_test_rows(spark):
    rows = planted(spark, 200).filter(F.col("year") < 2000)
    table, pairs, bins = heldout.time_split(rows, heldout.Columns(categories=["grp"], weather=["other"]), 2002)
    assert table.count() == 0 and bins.count() == 0
