"""Closed-form values, fitted models against known answers, and text patterns."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causaloom.functions import physics_sql as px
from causaloom.functions import vocab
from causaloom.operators import dedupe, networks, noisyor, stats, text
from causaloom.operators.components import connected_components
from causaloom.plans import catalog, registry  # noqa: F401  (registers the operators)
from causaloom.sources import loaders, sinks
from causaloom.streaming import incremental


def value(spark, expression):
    return spark.sql(f"SELECT {expression} AS v").first().v


@pytest.mark.parametrize(("t", "td", "w", "p"), [(72, 66, 3.1910, 0.8526), (10, 9, 2.1782, 0.7294), (37, 21, 3.3299, 0.8644), (57, 27, 3.5059, 0.8780)])
def test_icing_at_descent_power(spark, t, td, w, p):
    c = [f"(({x} - 32) * 5E0 / 9)" for x in (t, td)]
    assert value(spark, px.condensable(*c)) == pytest.approx(w, abs=5e-5) and value(spark, px.p_ice(*c)) == pytest.approx(p, abs=5e-5)


def test_icing_worked_case_and_heat(spark):
    assert value(spark, px.condensable("13E0", "12E0")) == pytest.approx(4.7397, abs=5e-5)
    assert value(spark, px.p_ice("13E0", "12E0")) == pytest.approx(0.9418, abs=5e-5)
    heated = f"({(10 - 32) * 5 / 9!r} + 30E0)"
    assert value(spark, px.condensable(heated, f"{(9 - 32) * 5 / 9!r}E0")) == pytest.approx(0.2547, abs=5e-5)


def test_gusts_and_fuel(spark):
    assert value(spark, px.pratt("120E0")) == pytest.approx(0.05484, abs=5e-6)
    assert value(spark, px.p_overload("120E0", ultimate=False)) == pytest.approx(0.07786, abs=5e-6)
    assert value(spark, px.p_overload("120E0")) == pytest.approx(0.01377, abs=5e-6)
    assert value(spark, px.p_gust_stall("65E0")) == pytest.approx(0.15053, abs=5e-6)
    assert value(spark, px.p_gust_stall("65E0", "severe")) == pytest.approx(0.38798, abs=5e-6)
    assert value(spark, px.p_shear_stall("65E0")) == pytest.approx(0.27253, abs=5e-6)
    for wind, p in ((25, 0.001393), (35, 0.175740)):
        assert value(spark, px.p_exceed_dryden(px.stall_gust("65E0"), f"{wind}E0", f"65E0 * {px.KT_TO_FPS}E0")) == pytest.approx(p, abs=5e-6)
    for hours, p in ((0.5, 0.2525), (1, 0.0912), (2, 0.0038)):
        assert value(spark, px.normal_tail(f"{hours}E0 / 0.75E0")) == pytest.approx(p, abs=5e-5)


def test_e_value_and_chi_square():
    assert 2 + math.sqrt(2) == pytest.approx(3.414214, abs=1e-6)
    for x, df, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (0.5, 1, math.erfc(0.5)), (40.0, 3, math.erfc(20**0.5) + (80 / math.pi) ** 0.5 * math.exp(-20))):
        assert networks.chi2_tail(x, df) == pytest.approx(p, rel=2e-3)


@pytest.mark.parametrize(("t", "found"), [("case ANC20FA012.", "ANC20FA012"), ("WPR05LA123 closed", "WPR05LA123"), ("xANC20FA012", None), ("ANC20FA01", None), ("anc20fa012", None), ("", None), ("DCA06MA064 and ANC20FA012", "DCA06MA064"), ("ANC20FA0123", None), ("ANC2OFA012", None), ("(ANC20FA012)", "ANC20FA012")])
def test_accident_ids(spark, t, found):
    d = spark.createDataFrame([(t,)], "t string")
    assert (d.select(F.regexp_extract("t", vocab.ACCIDENT_ID, 1)).first()[0] or None) == found


def test_closing_boundary_of_stems(spark):
    d = spark.createDataFrame([("while cruising",), ("while climbing to",), ("while the pilot",), ("because of",)], "t string")
    assert [r[0] for r in d.select(F.col("t").rlike(vocab.CAUSAL_PATTERN)).collect()] == [False, False, True, True]


def test_clean_text(spark):
    d = spark.createDataFrame([("ﬁne­ly re-\nport Page 3 of 9\tNational Transportation Safety Board  end\x07",), (None,)], "t string")
    assert [r[0] for r in d.select(text.clean_text(F.col("t"))).collect()] == ["finely report end", ""]


def test_noisy_or_recovers_its_parameters():
    rng = np.random.default_rng(0)
    x = np.array(list(itertools.product([0, 1], repeat=3)), float)
    leak, p = 0.1, np.array([0.6, 0.3, 0.05])
    prob = 1 - (1 - leak) * np.prod((1 - p) ** x, axis=1)
    n = rng.integers(20_000, 40_000, 8)
    hits = (prob * n).round()
    xs, ys, ns = np.concatenate([x, x]), np.array([True] * 8 + [False] * 8), np.concatenate([hits, n - hits]).astype(float)
    a, b, nll = noisyor.fit_leaky_noisy_or(xs, ys, ns)
    assert a == pytest.approx(leak, abs=5e-3) and b == pytest.approx(p, abs=1e-2)
    _, _, worse = noisyor.fit_leaky_noisy_or(xs, ys, ns, leaky=False)
    assert nll < worse


def test_pc_finds_a_collider_and_a_chain():
    rng = np.random.default_rng(1)
    a, b = rng.random(20_000) < 0.5, rng.random(20_000) < 0.5
    c = rng.random(20_000) < 0.1 + 0.4 * a + 0.4 * b
    d = rng.random(20_000) < 0.1 + 0.8 * c
    table, counts = np.unique(np.stack([a, b, c, d], 1), axis=0, return_counts=True)
    arrows, plain = networks.pc(table, counts.astype(float))
    assert arrows == {(0, 2), (1, 2), (2, 3)} and not plain


def test_cycles_lose_their_weakest_edge(spark):
    e = spark.createDataFrame([("c", "a", "b", 0.9, 5), ("c", "b", "d", 0.6, 5), ("c", "d", "a", 0.7, 5), ("c", "a", "e", 0.1, 1)], "category string, src string, dst string, score double, support long")
    assert sorted((r.src, r.dst) for r in networks.break_cycles(e).collect()) == [("a", "b"), ("a", "e"), ("d", "a")]


def test_bands_and_clusters(spark):
    assert dedupe.band_shape()[0] * dedupe.band_shape()[1] <= 128
    rng = random.Random(3)
    words = [str(rng.randint(0, 999)) for _ in range(200)]
    other = [str(rng.randint(0, 999)) for _ in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words[:199], "x"])), (4, " ".join(other)), (5, ""), (6, None), (7, "one two")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.cluster for r in dedupe.near_duplicate_clusters(d, verify=True).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    assert sorted((r.a, r.b) for r in dedupe.jaccard_pairs(d).collect()) == [(1, 2), (1, 3), (2, 3)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r.root for r in connected_components(chain).collect()} == {0}


def test_bootstrap_auc_holds_the_point(spark):
    d = spark.createDataFrame([(i, float(i % 50), int((i * 7) % 11 < 4 + (i % 50) // 20)) for i in range(600)], "doc_id long, score double, y int")
    r = stats.bootstrap_auc(d, rounds=200).first()
    assert r.low < r.auc < r.high


def test_isotonic_is_monotone(spark):
    d = spark.createDataFrame([(i, i / 300, int((i * 37) % 300 < i)) for i in range(300)], "doc_id long, score double, y int")
    got = stats.isotonic_out_of_fold(d).collect()
    assert len(got) == 300 and all(0 < r.p < 1 for r in got)


def test_permuted_pairs_is_a_bijection(spark):
    left, right = spark.range(100).withColumnRenamed("id", "l"), spark.range(100).withColumnRenamed("id", "r")
    got = stats.permuted_pairs(left, right).collect()
    assert sorted(x.l for x in got) == sorted(x.r for x in got) == list(range(100)) and sum(x.l == x.r for x in got) < 20


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "bea.csv").write_text("file_number,title,summary,date,location,state_of_occurrence,registration,detail_url\n1,T,S,01/02/2020,Paris,France,F-ABCD,u\n2,,,,,,,\n")
    got = [tuple(r) for r in loaders.bea(spark, str(tmp_path / "bea.csv")).orderBy("record_id").collect()]
    assert got[0] == ("1", "BEA", "01/02/2020", "Paris, France", "T", "S", "u", "F-ABCD") and got[1][3] == ", "
    (tmp_path / "a2000_01.txt").write_text("c5\tc9\tc13\tc14\tc22\tc119\n7\t20000101\tTX\tWaco\tN1\tremark\n8\t\\N\t\\N\t\\N\t\\N\tother\n")
    (tmp_path / "e2000_01.txt").write_text("C5\tREMARK\n7\tshort\n7\ta longer one\n")
    rows = {r.record_id: r for r in loaders.aids(spark, str(tmp_path / "a2000_01.txt"), str(tmp_path / "e2000_01.txt")).collect()}
    assert rows["7"].text == "a longer one" and rows["8"].text == "other" and rows["7"].source == "FAA_AIDS:2000_01"
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert loaders.jsonl(spark, str(tmp_path / "x.jsonl"), "a int").filter("a is not null").count() == 2
    (tmp_path / "hours").write_text("2000 1 2 3 100 120\n2000 1 2 4 -9999 5\n")
    assert [(r.t_c, r.td_c) for r in loaders.routine_hours(spark, str(tmp_path / "hours")).collect()] == [(10.0, 10.0)]
    done = spark.createDataFrame([("s", "1")], "source string, record_id string")
    todo = spark.createDataFrame([("s", "1"), ("s", "2")], "source string, record_id string")
    assert [r.record_id for r in sinks.remaining(todo, done).collect()] == ["2"]
    nodes, edges = spark.createDataFrame([("A", 2), ("B&", 1)], "factor_type string, n_records long"), spark.createDataFrame([("A", "B&", 3)], "src string, dst string, support long")
    assert 'target="B&amp;"' in sinks.graphml(nodes, edges)


def test_edges_count_a_record_once_and_leave_outcomes_out(spark):
    """A factor of two classes in one record, a repeated link, a link out of range, and a link into an outcome."""
    from causaloom.plans import catalog, registry  # noqa: F401

    nodes = spark.createDataFrame(
        [(1, 0, "fuel", "human"), (1, 1, "fuel", "machine"), (1, 2, "engine", "machine"), (1, 3, "crash", "outcome"), (2, 0, "fuel", "human"), (2, 1, "engine", "machine")],
        "record_id long, idx int, factor_type string, class string",
    )
    links = spark.createDataFrame([(1, 2, 0, 0, "inferred"), (1, 2, 1, 1, "direct"), (1, 3, 2, 0, "direct"), (2, 1, 0, 0, "direct"), (2, 1, 7, 1, "direct")], "record_id long, dst_idx int, src_idx int, link_pos int, strength string")
    got = [tuple(r) for r in registry.apply("causation_edges", spark, nodes=nodes, links=links).select("src", "dst", "support", "p_dst_given_src", "lift", "direct_share").collect()]
    assert got == [("fuel", "engine", 2, 1.0, 1.0, 0.5)]
    assert [tuple(r) for r in registry.apply("outcome_edges", spark, nodes=nodes, links=links).collect()] == [("engine", "crash", 1)]


def test_streamed_edges_equal_the_batch(spark, tmp_path):
    rows = [(f"r{i}", "A", "B") for i in range(5)] + [("r1", "A", "B"), ("r2", "B", "C")]
    data = str(tmp_path / "in")
    frame = spark.createDataFrame(rows, "record_id string, src string, dst string")
    frame.coalesce(1).write.parquet(data)
    stream = spark.readStream.schema(frame.schema).parquet(data)
    incremental.maintain(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    want = sorted(tuple(r) for r in incremental.edge_counts(frame).collect())
    assert sorted(tuple(r) for r in incremental.current(spark, str(tmp_path / "out")).collect()) == want


def test_frames_of_fitted_models(spark):
    assert isinstance(stats.stall_prior(spark).toPandas(), pd.DataFrame)


def test_primary_cause_and_cause_strings(spark):
    findings = spark.createDataFrame([(1, 1, "", "first"), (1, 2, "F", "second"), (1, 3, "C", "third"), (2, 1, "", "none"), (3, 1, None, "none")], "ev_id long, pos int, cause_factor string, description string")
    entries = spark.createDataFrame([(1, 1, "C", "ICE", "ON WING"), (2, 1, "F", "FUEL", ""), (2, 2, "C", "ROTOR", "None"), (2, 3, "c", "GEAR", "BENT"), (3, 1, "", "WIND", "")], "ev_id long, pos int, cause_factor string, subject string, modifier string")
    got = registry.apply("primary_cause", spark, findings=findings, coded_sequence=entries).collect()
    assert {r.ev_id: r.primary_cause for r in got} == {1: "second", 2: "ROTOR", 3: None}
    got = registry.apply("cause_strings", spark, findings=findings, coded_sequence=entries).collect()
    assert {r.ev_id: (r.causes, r.n) for r in got} == {1: ("second|third|ICE (ON WING)", 3), 2: ("ROTOR|GEAR (BENT)", 2)}


def test_tails_once_each_in_order(spark):
    texts = spark.createDataFrame([(1, "N12AB and C-FABC, then N12AB again"), (2, "none")], "c_custkey long, t string")
    got = {r.c_custkey: r.tails.split() for r in registry.apply("extract_tails", spark, tail_texts=texts).collect()}
    assert got[2] == [] and len(got[1]) == len(set(got[1])) and {"N12AB", "C-FABC"} <= set(got[1])


def test_pair_similarity_from_margins(spark):
    counts = {("a", "b"): 6, ("a", "c"): 1, ("b", "c"): 1, ("c", "d"): 4}
    pairs = spark.createDataFrame([("k", *p, n) for (x, y), n in counts.items() for p in ((x, y), (y, x))], "category string, i string, j string, cooccur long")
    judged = spark.createDataFrame([("k", "a", "b", "concurrent", 0.5), ("k", "b", "d", "a_before_b", 0.5), ("k", "a", "c", None, 0.9)], "category string, a string, b string, relation string, confidence double")
    got = {(r.i, r.j): r.similarity for r in registry.apply("pmi_similarity", spark, pair_counts=pairs, judgments=judged).collect()}
    total, margin = 24, {"a": 7, "b": 7, "c": 6, "d": 4}
    want = {p: 0.05 * max(0.0, math.log(n * total / (margin[p[0]] * margin[p[1]]))) for p, n in counts.items()}
    want["a", "b"] += 0.5
    want["b", "d"] = 0.3
    assert got == pytest.approx(want, abs=2e-6)


def test_laplacian_kernel(spark):
    rows = [("k", "a", "b", 1.0), ("k", "b", "c", 0.5), ("k", "c", "d", 0.25)]
    got = {(r.i, r.j): r.prior for r in networks.laplacian_prior(spark.createDataFrame(rows, "category string, i string, j string, similarity double")).collect()}
    s = np.zeros((4, 4))
    for _, i, j, v in rows:
        s["abcd".index(i), "abcd".index(j)] = s["abcd".index(j), "abcd".index(i)] = v
    v = np.linalg.eigh(np.diag(s.sum(1)) - s)[1][:, 1:]
    d2 = np.array([[((x - y) ** 2).sum() for y in v] for x in v])
    scale = np.median(d2[d2 > 0])
    assert got == pytest.approx({(a, b): math.exp(-d2["abcd".index(a), "abcd".index(b)] / scale) for a, b in itertools.combinations("abcd", 2)})


def test_search_goes_on_beyond_three_neighbours():
    """x and y depend on four common causes, and on nothing else together: only all four part them."""
    rng = np.random.default_rng(4)
    z = rng.random((60_000, 4)) < 0.5
    share = 0.06 + 0.22 * z.sum(1)
    x, y = (rng.random(60_000) < share for _ in range(2))
    table, counts = np.unique(np.column_stack([z, x, y]), axis=0, return_counts=True)
    arrows, plain = networks.pc(table, counts.astype(float), alpha=0.001)
    assert not {(4, 5), (5, 4)} & (arrows | plain) and len(arrows | plain) >= 8


def test_adjusted_effects_by_hand(spark):
    rng = random.Random(8)
    have = {i: {f for f in "abcd" if rng.random() < 0.4} for i in range(200)}
    severe = {i: rng.random() < 0.2 + 0.3 * ("a" in f) for i, f in have.items()}
    parents = {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["c"]}
    got = registry.apply(
        "backdoor_effect", spark,
        records=spark.createDataFrame([(i, 4 if s else 1) for i, s in severe.items()], "record_id long, sev_ordinal int"),
        causal_presence=spark.createDataFrame([(i, f) for i, fs in have.items() for f in fs], "record_id long, factor_type string"),
        parents=spark.createDataFrame([(f, p) for f, ps in parents.items() for p in ps], "factor string, parent string"),
    ).collect()
    want = {}
    for f, ps in parents.items():
        arms = []
        for treated in (True, False):
            total = 0.0
            for pattern in {frozenset(have[i] & set(ps)) for i in have}:
                stratum = [i for i in have if have[i] & set(ps) == pattern]
                arm = [i for i in stratum if (f in have[i]) == treated] or stratum
                total += len(stratum) * (sum(severe[i] for i in arm) + 1) / (len(arm) + 2)
            arms.append(total / len(have))
        want[f] = arms
    assert {r.factor: [r.p_do_1, r.p_do_0] for r in got} == {f: pytest.approx(v, abs=1e-6) for f, v in want.items()}
