"""Strict parse of the older format, answer by answer; pairs against a plain loop; the icing grid against numpy."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causaloom.operators import sensitivity, typed_edges

NODES = [{"id": "a", "kind": "event", "event_type": "ICE"}, {"id": "b", "kind": "event", "event_type": "FAIL"}]
GOOD = {"nodes": NODES, "edges": [{"src": "a", "dst": "b", "type": "CAUSES"}]}
CASES = [
    (json.dumps(GOOD), None), ("```json\n" + json.dumps(GOOD) + "\n```", None), (" \n```\n" + json.dumps(GOOD, indent=1) + "```\n", None), ("Here it is: " + json.dumps(GOOD) + " Done.", None),
    (None, "no object"), ("", "no object"), ("nothing", "no object"), ("} {", "no object"), ('{"nodes": [', "no object"), ('{"nodes": }', "invalid json"), ('{"nodes": []} and {"edges": []}', "invalid json"), ("{1: 2}", "invalid json"), ('{"a": {}},{"b": {}}', "invalid json"),
    ("{}", None), ('{"nodes": null, "edges": []}', None), ('{"nodes": "", "edges": false}', None), ('{"nodes": {"id": 1}}', "nodes or edges not arrays"), ('{"nodes": [], "edges": "x"}', "nodes or edges not arrays"), ('{"edges": 3}', "nodes or edges not arrays"),
    (json.dumps({"nodes": NODES, "edges": ["a", {"src": "z"}]}), "edge not an object"), (json.dumps({"nodes": NODES, "edges": [GOOD["edges"][0], {"src": "z", "dst": "y"}]}), "edge end not in nodes: z"),
    (json.dumps({"nodes": NODES, "edges": [{"src": "a", "dst": "y"}]}), "edge end not in nodes: y"), (json.dumps({"nodes": NODES, "edges": [{"src": "a"}]}), "edge end not in nodes: None"),
    (json.dumps({"nodes": ["x", 1, *NODES], "edges": GOOD["edges"]}), None), (json.dumps({"nodes": [*NODES, {"kind": "event"}], "edges": [{"src": "a"}]}), None), (json.dumps({"nodes": [{"id": 1}], "edges": [{"src": 1, "dst": "1"}]}), None), (json.dumps({"nodes": [], "edges": GOOD["edges"]}), "edge end not in nodes: a"),
]


def test_strict_parse_answer_by_answer(spark):
    rows = spark.createDataFrame([(i, raw, "mine") for i, (raw, _) in enumerate(CASES)], "id int, raw string, error string")
    got = {r.id: r for r in typed_edges.parsed(rows).collect()}
    assert {i: got[i].error for i in got} == {i: error for i, (_, error) in enumerate(CASES)}
    assert all((r.nodes is None) == (r.edges is None) == (r.error is not None) for r in got.values())
    assert [(e.src, e.dst, e.type) for e in got[1].edges] == [("a", "b", "CAUSES")] and [n.event_type for n in got[2].nodes] == ["ICE", "FAIL"] and got[13].nodes == []
    assert typed_edges.parsed(rows.limit(0)).count() == 0


def test_pairs_against_a_plain_loop(spark):
    r = random.Random(3)
    words, lines, want = ["A", "B", "C"], [], set()
    for k in range(500):
        nodes = [{"id": r.choice("uvwx"), "kind": r.choice(["event", "event", "entity"]), "event_type": r.choice([*words, "OUT"])} for _ in range(r.randint(0, 6))]
        ids = [n["id"] for n in nodes]
        edges = [{"src": r.choice(ids), "dst": r.choice(ids), "type": r.choice([*typed_edges.LEADING, "INVOLVES"])} for _ in range(r.randint(0, 6))] if ids else []
        lines.append((f"r{k}", json.dumps({"nodes": nodes, "edges": edges})))
        at = {n["id"]: n["event_type"] for n in nodes if n["kind"] == "event" and n["event_type"] in words}
        want |= {(f"r{k}", at[e["src"]], at[e["dst"]]) for e in edges if e["type"] != "INVOLVES" and e["src"] in at and e["dst"] in at and at[e["src"]] != at[e["dst"]]}
    vocabulary = spark.createDataFrame([(w,) for w in words], "factor_type string")
    pairs = typed_edges.typed_pairs(typed_edges.parsed(spark.createDataFrame(lines, "record_id string, raw string")), vocabulary)
    got = [tuple(x) for x in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    counts = {(x.src, x.dst): x.n for x in typed_edges.precedence(pairs.withColumn("category", F.lit("c"))).collect()}
    assert counts == {(a, b): sum(w[1:] == (a, b) for w in want) for _, a, b in want}
    empty = vocabulary.limit(0)
    assert typed_edges.typed_pairs(typed_edges.parsed(spark.createDataFrame(lines, "record_id string, raw string")), empty).count() == 0


def test_chain_pairs(spark):
    kind = "record_id string, nodes array<struct<idx:int,factor_type:string,caused_by:array<struct<src:int,strength:string>>>>"
    chains = [("a", [(0, "A", None), (1, "B", [(0, "direct"), (7, "direct")]), (2, "A", [(1, "x"), (0, "x")]), None, (3, "OUT", [(0, "x")])]), ("b", [(0, "A", [(0, "x")])]), ("c", None), ("d", [])]
    vocabulary = spark.createDataFrame([("A",), ("B",)], "factor_type string")
    assert sorted(tuple(x) for x in typed_edges.chain_pairs(spark.createDataFrame(chains, kind), vocabulary).collect()) == [("a", "A", "B"), ("a", "B", "A")]


def test_icing_grid_against_numpy(spark):
    rng = np.random.default_rng(5)
    t, td, y = rng.integers(-5, 30, 400).astype(float), rng.integers(-15, 25, 400).astype(float), (rng.random(400) < 0.3).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(t, td, y, strict=True)] + [(None, 1.0, 1), (1.0, None, 0), (float("nan"), 1.0, 1), (1.0, 1.0, None)], "t double, d double, label int")
    cells = [(a, b) for a in (0.75, 1.0, 1.25) for b in (0.5, 1.0)]
    found = sensitivity.icing_grid(rows, "t", "d", "label", cells + cells[:1])
    got = {(r.cooling_scale, r.exposure_scale): r for r in found.collect()}
    assert set(got) == set(cells) and found.count() == len(cells)

    def chance(t, d, cooling, exposure):
        pressure = lambda x: 6.112 * np.exp(17.62 * x / (243.12 + x))
        throat = t - cooling
        return np.where(throat < 0, 1 - np.exp(-exposure * np.maximum(0, pressure(np.minimum(np.minimum(d, t), 0)) - pressure(throat))), 0)

    for (a, b), r in got.items():
        p = chance(t, td, 32 * a, 0.6 * b).round(12)
        pairs = (p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])
        base, heat, dry = (float(chance(np.float64(x), np.float64(d), 32 * a, 0.6 * b)) for x, d in ((13, 12), (43, 12), (13, -5)))
        assert r.auc == pytest.approx(pairs.mean(), abs=2e-3) and (r.n, r.n_pos) == (400, int(y.sum()))
        assert (r.p_ice, r.risk, r.risk_heat, r.risk_dry) == pytest.approx((base, base * 0.667, heat * 0.667, dry * 0.667))
        assert r.ranking_preserved == (heat < dry < base)
    one = sensitivity.summary(found).first()
    along = [got[a, 1.0].auc for a in (0.75, 1.0, 1.25)]
    assert (one.auc_min_cooling, one.auc_max_cooling) == (min(along), max(along)) and one.ranking_preserved_everywhere == all(r.ranking_preserved for r in got.values())
    nothing = sensitivity.icing_grid(rows.limit(0), "t", "d", "label", cells).collect()
    assert len(nothing) == len(cells) and all(r.auc is None and r.n == 0 for r in nothing)
