"""Adjusted effects against records one by one, intervals against redrawn records and known effects."""

import collections
import math

import numpy as np
import pytest

from causaloom.operators import ancestral, effects

PATTERNS = "category string, pattern string, n long, y long"


def packed(category, columns, y):
    """Pattern rows of records given by factor columns."""
    got = collections.defaultdict(lambda: [0, 0])
    for k in range(len(y)):
        p = ",".join(f for f, c in columns.items() if c[k])
        got[p][0] += 1
        got[p][1] += int(y[k])
    return [(category, p, n, s) for p, (n, s) in got.items()]


def brute(columns, y, x, parents):
    """(do absent, do present) by strata of the records."""
    strata = collections.defaultdict(list)
    for k in range(len(y)):
        strata[tuple(columns[p][k] for p in parents)].append(k)
    out = [0.0, 0.0]
    for rows in strata.values():
        pool = (sum(y[k] for k in rows) + 1) / (len(rows) + 2)
        for arm in (0, 1):
            own = [k for k in rows if columns[x][k] == arm]
            if parents:
                risk = (sum(y[k] for k in own) + 1) / (len(own) + 2) if own else pool
            else:
                risk = (sum(y[k] for k in own) + 1) / (len(own) + 2) if own else sum(y) / len(y)
            out[arm] += len(rows) / len(y) * risk
    return out


def confounded(rng, n):
    c = (rng.random(n) < 0.4).astype(int)
    d = (rng.random(n) < 0.3).astype(int)
    x = (rng.random(n) < 0.2 + 0.5 * c).astype(int)
    y = (rng.random(n) < 0.1 + 0.3 * c + 0.1 * d + 0.2 * x).astype(int)
    return {"C": c, "D": d, "X": x}, y


def test_effects_against_records(spark):
    rng, rows, given = np.random.default_rng(1), [], {}
    for category, n in (("a", 300), ("b", 45)):
        columns, y = confounded(rng, n)
        columns["ALL"], columns["RARE"] = np.ones(n, int), (np.arange(n) < 5).astype(int)
        given[category] = columns, y
        rows += packed(category, columns, y)
    patterns = spark.createDataFrame(rows, PATTERNS)
    parents = spark.createDataFrame([(c, f, p) for c in "ab" for f, p in (("X", "C"), ("X", "D"), ("X", "RARE"), ("X", "ALL"), ("C", "D"), ("D", "RARE"))], "category string, factor string, parent string")
    sets = effects.adjustment_sets(patterns, parents, least=10, most=2)
    chosen = {(r.category, r.factor): r.adjustment for r in sets.collect()}
    support = {(c, f): int(v.sum()) for c, (cols, _) in given.items() for f, v in cols.items()}
    assert set(chosen) == {k for k, n in support.items() if n >= 10}
    for (c, f), adjustment in chosen.items():
        mine = [p for x, p in (("X", "C"), ("X", "D"), ("X", "ALL"), ("C", "D")) if x == f and support[c, p] >= 10]
        assert adjustment == sorted(mine, key=lambda p: (-support[c, p], p))[:2]
    got = effects.adjusted_effects(effects.effect_cells(patterns, sets), sets).collect()
    assert len(got) == len(chosen)
    for r in got:
        columns, y = given[r.category]
        assert (r.p0, r.p1) == pytest.approx(brute(columns, y, r.factor, r.adjustment), abs=1e-12)
        assert (r.n, r.n_present) == (len(y), support[r.category, r.factor])
        arms = [y[columns[r.factor] == k] for k in (0, 1)]
        if len(arms[0]):
            assert r.crude == pytest.approx((arms[1].sum() + 1) / (len(arms[1]) + 2) - (arms[0].sum() + 1) / (len(arms[0]) + 2))
        else:
            assert r.crude is None and r.factor == "ALL"


def test_intervals_cover_the_effect_and_match_redrawn_records(spark):
    rng, rows, first = np.random.default_rng(2), [], None
    for k in range(60):
        columns, y = confounded(rng, 500)
        first = first or (columns, y)
        rows += packed(f"s{k:02d}", columns, y)
    patterns = spark.createDataFrame(rows, PATTERNS)
    parents = spark.createDataFrame([(f"s{k:02d}", "X", p) for k in range(60) for p in "CD"], "category string, factor string, parent string")
    found = {r.category: r for r in effects.interventions(patterns, parents, redraws=400).filter("factor = 'X'").collect()}
    assert len(found) == 60 and all(r.low < r.adjusted < r.high and r.adjustment == ["C", "D"] for r in found.values())
    assert 51 <= sum(r.low <= 0.2 <= r.high for r in found.values()) <= 60  # the true effect is 0.2
    assert np.mean([r.crude for r in found.values()]) > 0.3 and np.mean([r.adjusted for r in found.values()]) == pytest.approx(0.2, abs=0.02)
    columns, y = first
    redrawn = []
    for _ in range(400):
        own = rng.integers(0, len(y), len(y))
        p0, p1 = brute({f: c[own] for f, c in columns.items()}, y[own], "X", ["C", "D"])
        redrawn.append(p1 - p0)
    assert (found["s00"].low, found["s00"].high) == pytest.approx(np.percentile(redrawn, [2.5, 97.5]), abs=0.025)


def test_places_are_by_effect_in_a_category(spark):
    columns, y = confounded(np.random.default_rng(5), 400)
    patterns = spark.createDataFrame(packed("a", columns, y) + packed("b", columns, y), PATTERNS)
    none = spark.createDataFrame([], "category string, factor string, parent string")
    rows = effects.interventions(patterns, none, redraws=60).collect()
    for category in "ab":
        own = sorted((r for r in rows if r.category == category), key=lambda r: r.place)
        assert [r.place for r in own] == [1, 2, 3] and [r.adjusted for r in own] == sorted((r.adjusted for r in own), reverse=True)
        assert all(r.adjusted == pytest.approx(r.crude) for r in own)


def test_stable_parents_and_strongest_edges(spark):
    edges = spark.createDataFrame([("a", f"s{k}", "t", 10 + k // 2) for k in range(6)] + [("b", "s0", "t", 1)], "category string, src string, dst string, support long")
    share = spark.createDataFrame([("a", f"s{k}", "t", 0.5 if k != 3 else 0.49) for k in range(6)] + [("a", "t", "s3", 0.9)], "category string, src string, dst string, stability double")
    assert sorted(r.parent for r in effects.stable_parents(edges, share).collect()) == ["s0", "s1", "s2", "s4", "s5"]
    assert [(r.place, r.src, r.support) for r in effects.strongest_edges(edges, share, most=4).orderBy("place").collect()] == [(1, "s4", 12), (2, "s5", 12), (3, "s2", 11), (4, "s0", 10)]


def test_hidden_causes(spark):
    """A set whose member is confounded with the factor, and one whose member causes it."""
    rng, n = np.random.default_rng(7), 40_000
    rows = []
    for category in ("hidden", "open"):
        a, b, h = ((rng.random(n) < 0.5).astype(int) for _ in range(3))
        x = (rng.random(n) < 0.1 + 0.4 * (h if category == "hidden" else b) + 0.4 * a).astype(int)
        f = (rng.random(n) < (0.1 + 0.4 * h + 0.4 * b if category == "hidden" else 0.1 + 0.7 * x)).astype(int)
        y = (rng.random(n) < 0.05 + 0.2 * f + 0.2 * x).astype(int)
        rows += packed(category, {"A": a, "B": b, "F": f, "X": x}, y)
    patterns = spark.createDataFrame(rows, PATTERNS)
    parents = spark.createDataFrame([("hidden", "F", "X"), ("open", "F", "X"), ("open", "F", "A")], "category string, factor string, parent string")
    found = effects.interventions(patterns, parents, redraws=100)
    pag = ancestral.fci_by_category(patterns, alpha=0.001)
    got = {r.category: r for r in effects.hidden_cause_check(patterns, found, ancestral.relations(pag)).collect()}
    assert set(got) == {"hidden", "open"}
    r = got["hidden"]
    assert r.relations == ["X:confounded"] and r.confounded and r.definite == [] and r.adjusted_definite == pytest.approx(r.crude)
    r = got["open"]
    assert r.relations == ["A:absent", "X:parent"] and not r.confounded and r.definite == r.possible == ["X"]
    assert r.adjusted_definite == pytest.approx(0.2, abs=0.02) and r.crude > r.adjusted + 0.05
    for r in got.values():
        e = lambda q: q + math.sqrt(q * (q - 1))
        assert r.e_value == pytest.approx(e(r.p1 / r.p0)) and r.e_value_bound == pytest.approx(e((r.p0 + r.low) / r.p0)) and 1 < r.e_value_bound < r.e_value
