"""Stations against all pairs, also at the date line and near the poles; binned densities against plain ones."""

import math
import random

import numpy as np
import pytest

from causaloom.operators import density, stations, stats


def distance(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_stations_against_all_pairs(spark):
    r = random.Random(1)
    centres = [(40.0, -100.0), (64.9, 179.9), (89.6, 10.0), (-88.9, -170.0), (0.0, 0.05), (-33.0, -179.95)]

    def place(spread=0.7):
        lat, lon = r.choice(centres)
        lat = max(-89.99, min(89.99, lat + r.uniform(-spread, spread)))
        return lat, (lon + r.uniform(-spread, spread) / max(0.01, math.cos(math.radians(lat))) + 180) % 360 - 180

    sites = [(k, *place(), 2000 + k % 3, 1 + k % 2, r.choice([None, "", "ab", "cd"])) for k in range(250)] + [(900, None, 1.0, 2000, 1, "ab"), (901, 40.0, -100.0, 1900, 1, "ab")]
    posts = [(f"s{k:03d}", r.choice(["KAB", "KCD", "XX", None]), *place(), 1990 + k % 12, 2001 + k % 3, r.choice([True, False, None])) for k in range(200)]
    hours = [(s[0], y, m, r.choice([0, 99, 100, 500])) for s in posts for y in (2000, 2001, 2002) for m in (1, 2) if r.random() < 0.8]
    cases = spark.createDataFrame(sites, "case_id long, lat double, lon double, year int, month int, facility string")
    known = spark.createDataFrame(posts, "station string, code string, lat double, lon double, begin_year int, end_year int, known boolean")
    months = spark.createDataFrame(hours, "station string, year int, month int, n_hours int")
    enough = {h[:3]: h[3] for h in hours if h[3] >= 100}
    want, wins = {}, {}
    for case, lat, lon, year, month, facility in sites:
        near = []
        for name, code, a, b, begin, end, sure in posts if lat is not None else ():
            if begin <= year <= end and (km := distance(lat, lon, a, b)) <= 60:
                near.append((not (facility and code == "K" + facility.upper()), not sure, km, name))
        want[case] = [(s, pytest.approx(km, abs=1e-6)) for *_, km, s in sorted(near)[:3]]
        wins[case] = next(((s, place, enough[s, year, month]) for place, (*_, s) in enumerate(sorted(near)[:3], 1) if (s, year, month) in enough), (None, None, None))
    got = {}
    for x in stations.candidates(cases, known).orderBy("case_id", "place").collect():
        got.setdefault(x.case_id, []).append((x.station, x.km))
    assert got == {c: v for c, v in want.items() if v} and len(got) > 100
    resolved = stations.resolve_stations(cases, known, months).collect()
    assert {x.case_id: (x.station, x.place, x.n_hours) for x in resolved} == wins and len(resolved) == len(sites) and any(w[1] and w[1] > 1 for w in wins.values())


def test_densities_against_plain_ones(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(900) < 0.35).astype(int)
    points = rng.normal(size=(900, 2)) * 6 + y[:, None] * np.array([4.0, -3.0])
    rows = spark.createDataFrame([(k, float(a), float(b), int(t)) for k, ((a, b), t) in enumerate(zip(points, y, strict=True))] + [(2000, None, 1.0, 1), (2001, 1.0, 1.0, None)], "id long, t double, d double, y int")
    fold = {r.id: r.fold for r in stats.folds(rows.filter("t IS NOT NULL AND y IS NOT NULL").selectExpr("id", "t AS x", "d AS y", "y AS label"), "label", "id").collect()}
    fold = np.array([fold[k] for k in range(900)])
    got = {r.bandwidth: r for r in density.density_ratio_auc(rows, "t", "d", "y", "id", (1.0, 3.0)).collect()}
    for bandwidth in (1.0, 3.0):
        score = np.zeros(900)
        for f in range(5):
            here = fold == f
            for c, sign in ((1, 1), (0, -1)):
                own = points[(y == c) & ~here]
                d2 = ((points[here][:, None] - own[None]) ** 2).sum(-1)
                score[here] += sign * np.log(np.maximum(np.exp(-d2 / 2 / bandwidth**2).sum(1) / len(own), 1e-300))
        pos, neg = score[y == 1], score[y == 0]
        auc = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
        assert got[bandwidth].auc == pytest.approx(auc, abs=0.006) and (got[bandwidth].n_pos, got[bandwidth].n_neg) == (y.sum(), 900 - y.sum())


def test_binned_density_keeps_its_bound():
    rng = np.random.default_rng(3)
    own, at = rng.normal(size=(400, 2)), rng.normal(size=(300, 2))
    for fineness in (2, 8):
        snap = lambda p: (np.floor(p * fineness) + 0.5) / fineness
        f = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / 2).mean(1)
        assert np.abs(f(at, own) - f(snap(at), snap(own))).max() <= density.density_error(1.0, fineness)


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, t double, d double, y int")
    assert density.density_ratio_auc(none, "t", "d", "y", "id").count() == 0


def _pair_rows(frame):
    """Rows that joins of the executed plan put out, by its own metrics."""
    frame.collect()
    total, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            total += node.metrics().apply("numOutputRows").value()
    return total


def test_nearest_stations_against_all_pairs(spark):
    r = random.Random(4)
    spots = [(r.uniform(30, 33), r.uniform(-100, -96)) for _ in range(12)]
    sites = [(k % 190, *r.choice(spots), r.choice([2000, 2005, None])) for k in range(200)] + [(900, None, 1.0, 2000), (901, -0.0, 0.0, 2000)]  # ten sites have two rows
    posts = [(k % 140, *r.choice(spots), 1990 + k % 12, 2001 + k % 6, r.choice([True, False, None])) for k in range(150)] + [(999, 0.0, -0.0, 1990, 2010, True), (998, None, 0.0, 1990, 2010, True)]
    near = {}
    for site, lat, lon, yr in sites:
        for name, a, b, begin, end, wban in posts:
            if None not in (lat, a, yr) and begin <= yr <= end and abs(lon - b) <= 3 and (km := distance(lat, lon, a, b)) <= 60:
                near.setdefault(site, []).append((not wban, round(km, 9), name))
    want = [(site, rn, name) for site, found in near.items() for rn, (_, _, name) in enumerate(sorted(found)[:3], 1)]
    got = stations.nearest_stations(spark.createDataFrame(sites, "site long, lat double, lon double, yr int"), spark.createDataFrame(posts, "station long, lat double, lon double, begin_year int, end_year int, wban boolean")).collect()
    assert sorted((x.site, x.rn, x.station) for x in got) == sorted(want) and len(near) > 100
    assert all(abs(x.km - sorted(near[x.site])[x.rn - 1][1]) < 6e-4 for x in got)


def test_many_cases_and_stations_of_one_place_are_not_paired(spark):
    cases = spark.range(2000).selectExpr("id AS case_id", "40.0D AS lat", "-100.0D AS lon", "2000 AS year", "cast(id % 12 + 1 AS int) AS month", "CAST(NULL AS string) AS facility")
    posts = spark.range(500).selectExpr("id AS station", "'KX' AS code", "40.1D AS lat", "-100.1D AS lon", "1990 AS begin_year", "2010 AS end_year", "id % 2 = 0 AS known")
    found = stations.candidates(cases, posts)
    assert {(x.place, x.station) for x in found.collect()} == {(1, 0), (2, 2), (3, 4)} and found.count() == 6000
    assert _pair_rows(found) < 20_000
    close = stations.nearest_stations(cases.selectExpr("case_id AS site", "lat", "lon", "year AS yr"), posts.selectExpr("station", "lat", "lon", "begin_year", "end_year", "known AS wban"))
    assert {(x.rn, x.station) for x in close.collect()} == {(1, 0), (2, 2), (3, 4)} and close.count() == 6000
    assert _pair_rows(close) < 20_000
