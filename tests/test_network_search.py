"""The constraint-based search on dense categories, and how its redraws are dealt."""

import itertools
import time

import numpy as np
import pytest

from causaloom.operators import ancestral, networks
from causaloom.plans import catalog, custom


def dense(k, n=400_000, seed=3):
    """Patterns of k variables that one hidden cause ties together: no conditioning set parts a pair."""
    rng = np.random.default_rng(seed)
    x = np.array(list(itertools.product((0, 1), repeat=k)), bool)
    p = 0.5 * np.prod(np.where(x, 0.3, 0.7), axis=1) + 0.5 * np.prod(np.where(x, 0.6, 0.4), axis=1)
    return x, rng.multinomial(n, p / p.sum()).astype(float)


def plain(x, n, i, j, given, alpha):
    """Stratum by stratum, from expected counts."""
    stat, df = 0.0, 0
    for values in itertools.product((0, 1), repeat=len(given)):
        own = np.all(x[:, list(given)] == np.array(values, bool), axis=1) if given else np.ones(len(x), bool)
        t = np.array([[n[own & (x[:, i] == a) & (x[:, j] == b)].sum() for b in (0, 1)] for a in (0, 1)])
        if t.sum() and t.sum(1).all() and t.sum(0).all():
            e = np.outer(t.sum(1), t.sum(0)) / t.sum()
            stat, df = stat + ((t - e) ** 2 / e).sum(), df + 1
    return df == 0 or networks.chi2_tail(stat, df) > alpha


@pytest.mark.parametrize("learn", [networks.pc, lambda x, n: ancestral.fci(x.shape[1], networks.ChiSquare(x, n, 0.05))], ids=["pc", "fci"])
def test_dense_category_ends_soon(learn):
    x, n = dense(12)
    began = time.process_time()
    learn(x, n)
    assert time.process_time() - began < 30


@pytest.mark.parametrize("held", [True, False], ids=["summed", "test by test"])
def test_many_tests_at_once_agree_with_single_ones(held):
    rng = np.random.default_rng(5)
    x = np.array(list(itertools.product((0, 1), repeat=7)), bool)[rng.permutation(128)[:90]]
    n = rng.poisson(3, 90).astype(float)
    tests = networks.ChiSquare(x, n, 0.05)
    if not held:
        tests.sums = None
    for i, j in itertools.combinations(range(7), 2):
        others = [v for v in range(7) if v not in (i, j)]
        for size in range(6):
            sets = list(itertools.combinations(others, size))
            want = [g for g in sets if plain(x, n, i, j, g, 0.05)]
            assert tests.first(i, j, sets) == (want[0] if want else None)
            assert [g for g in sets if tests(i, j, g)] == want


def test_redraws_are_not_put_into_one_task(spark):
    rows = [("A", ",".join(f for f, b in zip("abcd", bits, strict=True) if b), 20 + 7 * i) for i, bits in enumerate(itertools.product((0, 1), repeat=4))]
    plan = networks.bootstrap_stability(spark.createDataFrame(rows, "category string, pattern string, n long"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(category" in plan and "REPARTITION_BY_NUM" in plan


def test_one_pass_over_the_chains_counts_what_the_queries_count(spark, sf_dir):
    query = catalog.queries().__getitem__
    patterns, supports = custom._chain_counts(spark, sf_dir)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    assert rows(patterns, "category", "pattern", "n", "y") == rows(query("outcome_patterns")(spark, sf_dir), "category", "pattern", "n", "y")
    assert rows(custom._present(patterns), "category", "pattern", "n") == rows(query("presence_patterns")(spark, sf_dir), "category", "pattern", "n")
    assert rows(supports, "category", "src", "dst", "support") == rows(query("category_edges")(spark, sf_dir), "category", "src", "dst", "support")
    pairs, precedence, judged, _ = custom._known(custom._present(patterns), supports)
    assert rows(pairs, "category", "i", "j", "cooccur") == rows(query("cooccurrence")(spark, sf_dir), "category", "i", "j", "cooccur")
    assert rows(precedence, "category", "i", "j", "n") == rows(query("precedence")(spark, sf_dir), "category", "i", "j", "n")
    assert judged.count() * 2 == pairs.count()


def test_pairs_are_tested_given_all_sets_at_once(monkeypatch):
    x, n = dense(9, n=3000)
    want = networks.skeleton(9, lambda i, j, g: networks.independent(x, n, i, j, g, 0.05))
    looked, accepted = [], networks._accepted
    monkeypatch.setattr(networks, "_accepted", lambda cells, alpha: looked.append(cells[0].size) or accepted(cells, alpha))
    assert networks.skeleton(9, networks.ChiSquare(x, n, 0.05)) == want
    assert len(looked) < 36 * 2 * 9  # no set of three or more is looked up by itself


def test_larger_sets_are_looked_up_and_not_gone_through():
    rng = np.random.default_rng(8)
    x = np.array(list(itertools.product((0, 1), repeat=8)), bool)[rng.permutation(256)[:150]]
    tests = networks.ChiSquare(x, rng.poisson(4, 150).astype(float), 0.05)
    for i, j in itertools.permutations(range(8), 2):
        others = [v for v in range(8) if v not in (i, j) and rng.random() < 0.8]
        for size in range(len(others) + 2):
            assert tests.within(i, j, others, size) == next((g for g in itertools.combinations(others, size) if tests(i, j, g)), None)


def test_one_job_searches_the_patterns_and_their_redraws(spark):
    rng = np.random.default_rng(2)
    rows = [(c, ",".join(f for f, b in zip("abcde", bits, strict=True) if b), int(rng.poisson(40 if sum(bits) % 2 else 15)) + 1) for c in "AB" for bits in itertools.product((0, 1), repeat=5)]
    df = spark.createDataFrame(rows, "category string, pattern string, n long")
    found = networks.searches(df, 4).cache()
    got = lambda d, *c: sorted(map(tuple, d.select(*c).collect()))
    edges = "category", "src", "dst", "directed"
    assert got(found.filter("b < 0"), *edges) == got(networks.pc_by_category(df), *edges) != []
    assert got(networks.stability(found, 4), "category", "src", "dst", "stability") == got(networks.bootstrap_stability(df, 4), "category", "src", "dst", "stability") != []
    found.unpersist()


def test_chains_of_odd_events_are_counted(spark, tmp_path):
    import datetime as dt

    rng = np.random.default_rng(4)
    kinds = ["click", "error", "purchase", "signup", "view", "other", None]
    day = dt.datetime(2024, 1, 1)
    rows = [(k if rng.random() > 0.03 else None, day + dt.timedelta(minutes=7 * k) if rng.random() > 0.05 else None, int(rng.integers(9)) if rng.random() > 0.05 else None, kinds[rng.integers(7)], float(rng.integers(300)), f'{{"k": {rng.integers(9)}}}' if rng.random() > 0.1 else [None, "{}"][k % 2]) for k in range(900)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    query = catalog.queries().__getitem__
    patterns, supports = custom._chain_counts(spark, str(tmp_path))
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    known = "category IS NOT NULL"
    assert rows(patterns.filter(known), "category", "pattern", "n", "y") == rows(query("outcome_patterns")(spark, str(tmp_path)).filter(known), "category", "pattern", "n", "y")
    assert rows(custom._present(patterns), "category", "pattern", "n") == rows(query("presence_patterns")(spark, str(tmp_path)), "category", "pattern", "n")
    assert rows(supports, "category", "src", "dst", "support") == rows(query("category_edges")(spark, str(tmp_path)), "category", "src", "dst", "support")


def test_a_dense_search_of_twelve_factors_is_quick():
    x, n = dense(12)
    networks.pc(x, n)
    began = time.process_time()
    tests = networks.ChiSquare(x, n, 0.05)
    networks.skeleton(12, tests)
    tables = len(tests.by_size)
    took = time.process_time() - began
    assert tables == 66 and took < 5
