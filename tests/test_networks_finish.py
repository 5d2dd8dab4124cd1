"""Networks after the search, edge by edge."""

import pytest

from causaloom.operators import networks

PAIRS = [("A", "B", 20), ("A", "C", 9), ("B", "C", 30), ("C", "D", 12), ("A", "D", 50), ("D", "E", 10), ("B", "E", 40), ("C", "E", 11), ("A", "E", 15)]


def tables(spark):
    both = [("k", i, j, n) for i, j, n in PAIRS] + [("k", j, i, n) for i, j, n in PAIRS]
    cooccurrence = spark.createDataFrame(both, "category string, i string, j string, cooccur long")
    precedence = spark.createDataFrame([("k", "A", "B", 6), ("k", "B", "A", 2), ("k", "B", "C", 3), ("k", "E", "C", 9), ("k", "E", "B", 8), ("other", "A", "B", 99)], "category string, i string, j string, n long")
    judgments = spark.createDataFrame([("k", "B", "C", "b_before_a", 0.9), ("k", "A", "D", "concurrent", 0.9), ("k", "E", "D", "b_before_a", 0.4), ("k", "A", "E", None, 1.0), ("k", "B", "E", "a_before_b", 0.7), ("k", "E", "B", "a_before_b", 0.2)], "category string, i string, j string, relation string, confidence double")
    priors = spark.createDataFrame([("k", "A", "B", 0.5), ("k", "B", "C", 0.4), ("k", "C", "D", 0.39), ("k", "A", "D", 0.9), ("k", "C", "E", 0.1), ("k", "B", "E", 0.3)], "category string, i string, j string, prior double")
    return cooccurrence, precedence, judgments, priors


def test_finished_network(spark):
    found = spark.createDataFrame([("k", "A", "B", True), ("k", "A", "C", True), ("k", "B", "C", False), ("k", "C", "D", True), ("k", "A", "D", False), ("k", "D", "E", False), ("k", "A", "E", False), ("k", "X", "Y", True)], "category string, src string, dst string, directed boolean")
    got = sorted(tuple(r) for r in networks.finished_network(found, *tables(spark)).collect())
    assert got == [
        ("k", "A", "B", pytest.approx(0.7), 20, None, 0.5, True, False, False), ("k", "A", "D", 0.5, 50, None, 0.9, False, False, True), ("k", "A", "E", 0.5, 15, None, None, False, False, True),
        ("k", "C", "B", 0.9, 30, 0.9, 0.4, False, True, True), ("k", "D", "A", 0.5, 50, None, 0.9, False, False, True), ("k", "D", "E", 0.4, 10, 0.4, None, False, True, True), ("k", "E", "A", 0.5, 15, None, None, False, False, True),
    ]
    plain = networks.finished_network(found, *tables(spark)[:2], least=1).collect()
    assert {(r.src, r.dst) for r in plain} == {("A", "B"), ("A", "C"), ("C", "D"), *[(a, b) for p in ("BC", "AD", "DE", "AE") for a, b in (p, p[::-1])]}
    assert networks.finished_network(found.limit(0), *tables(spark)).count() == 0


def test_dense_network(spark):
    got = {(r.src, r.dst): (round(r.score, 6), r.support, r.judged, r.evidence) for r in networks.dense_network(*tables(spark)).collect()}
    assert got == {("A", "B"): (0.7, 20, None, "precedence"), ("C", "B"): (0.2, 30, 0.9, "judgment"), ("B", "E"): (0.1, 40, 0.7, "judgment")}
    loose = {(r.src, r.dst) for r in networks.dense_network(*tables(spark), least_prior=0.0).collect()}
    assert loose == {*got, ("E", "C")}


def test_cycles_by_score_then_judgment_then_support(spark):
    kind = "category string, src string, dst string, score double, support long, judged double, evidence string"
    ring = [("k", "A", "B", 0.5, 9, None, "x"), ("k", "B", "C", 0.5, 1, 0.3, "x"), ("k", "C", "A", 0.5, 5, 0.3, "x"), ("q", "A", "B", 0.4, 9, 0.9, "x"), ("q", "B", "A", 0.5, 1, None, "x")]
    left = networks.break_cycles(spark.createDataFrame(ring, kind)).collect()
    assert {(r.category, r.src, r.dst) for r in left} == {("k", "B", "C"), ("k", "C", "A"), ("q", "B", "A")}
