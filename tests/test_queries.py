"""Every relational operator against its DuckDB twin on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from causaloom.plans import catalog, registry
from causaloom.plans.registry import TABLES

ORACLES = catalog.oracle_sql()
CUSTOM = [n for n in catalog.queries() if n not in registry.OPERATORS]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    return c


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]

    def one(x):
        if x is None or (not isinstance(x, str) and pd.isna(x)):
            return None
        return x if isinstance(x, (str, bool)) else round(float(x), 6) + 0.0

    return sorted((tuple(one(x) for x in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, duck, name):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(n for n in CUSTOM if n not in ORACLES))
def test_custom_query_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() >= 0


def test_driver_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["src", "dst", "support", "p_dst_given_src", "lift", "direct_share"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_operator_on_own_frames(spark):
    """Users bind their own chains; an expected table worked out by hand."""
    nodes = spark.createDataFrame([("r1", 0, "condition", "ICE"), ("r1", 1, "event", "FAIL"), ("r2", 0, "event", "FAIL"), ("r3", 0, "condition", "ICE"), ("r3", 1, "event", "FAIL"), ("r3", 2, "event", "FAIL")], "record_id string, idx int, class string, factor_type string")
    links = spark.createDataFrame([("r1", 1, 0, 0, "direct"), ("r3", 1, 0, 0, "contributing"), ("r3", 2, 0, 0, "direct")], "record_id string, dst_idx int, link_pos int, src_idx int, strength string")
    got = registry.apply("causation_edges", spark, nodes=nodes, links=links).collect()
    assert [tuple(r) for r in got] == [("ICE", "FAIL", 2, 1.0, 1.0, 0.5)]
    assert math.isclose(got[0].lift, 1.0)


def test_evaluation_and_task_operators_take_all_rows(spark):
    """Nothing is left out by the value of a hash, key or speed."""
    matches = spark.createDataFrame([("r", i, "primary", "event", i, 3, 7 * i + 1) for i in range(3)], "record_id string, finding int, cause_role string, class string, node int, n_nodes long, h long")
    nodes = spark.createDataFrame([("r", i, f"F{i}") for i in range(3)], "record_id string, idx int, factor_type string")
    got = registry.apply("adjudication_pairs", spark, matches=matches, nodes=nodes).collect()
    assert sorted((r.finding, r.node_idx, r.judge_match) for r in got) == [(i, j, int(i == j)) for i in range(3) for j in range(3)]
    orders = spark.createDataFrame([(k, "O", 10.0 * k) for k in range(1, 10)], "o_orderkey long, o_orderstatus string, o_totalprice double")
    got = registry.apply("task_priority", spark, orders=orders).collect()
    assert sorted((r.o_orderkey, r.place) for r in got) == [(k, k) for k in range(1, 10)]
    labels, documents = (spark.createDataFrame([(i,) for i in ids], "doc_id long") for ids in ((1, 2, 3, 7), (1, 2, 4, 5)))
    got = registry.apply("key_equality", spark, labels=labels, documents=documents).collect()
    assert sorted((r.doc_id, r.only_in) for r in got) == [(3, "left"), (4, "right"), (5, "right"), (7, "left")]
    speeds = spark.createDataFrame([(k, float(k)) for k in (61, 62, 65)], "kt long, v double")
    assert registry.apply("dryden_gust_stall", spark, speeds=speeds).groupBy("kt").count().filter("count = 46").count() == 3


def test_supervision_block_lines(spark):
    """The block that the prompt expects, line by line."""
    findings = spark.createDataFrame([("a", i, "C" if i % 2 else "", f"d{i}") for i in range(1, 18)] + [("b", i, "F", f"e{i}") for i in range(1, 16)], "ev_id string, pos int, cause_factor string, description string")
    entries = spark.createDataFrame([("a", i, 1, "", "None" if i == 2 else f"s{i}", "m" if i == 1 else None) for i in range(1, 34)] + [("c", 1, 2, "C", "only", "")] + [("n", 1, 1, "", "None", "")], "ev_id string, pos int, occurrence int, cause_factor string, subject string, modifier string")
    places = spark.createDataFrame([("a", 2, "FIRE", ""), ("a", 1, " LOSS ", "CRUISE "), ("x", 1, "FIRE", "")], "ev_id string, pos int, code_text string, phase_text string")
    whole = spark.createDataFrame([("a", " wind ", "ice", 1, None, 2, 0, " DEST "), ("b", "", None, None, None, None, None, "SUBS"), ("x", " ", None, 1, 0, 0, 0, "DEST"), ("p", "fuel", "", None, None, None, None, "")],
                                  "ev_id string, primary_cause_text string, secondary_cause_text string, fatal int, serious int, minor int, unhurt int, damage string")
    got = {r.ev_id: r.block for r in registry.apply("supervision_block", spark, findings=findings, coded_sequence=entries, occurrences=places, structured=whole).collect()}
    head = ["STRUCTURED FINDINGS (official investigation):"]
    sequence = ["Sequence of events:", "  [occ 1] [-] s1 - m"] + [f"  [occ 1] [-] s{i}" for i in range(3, 31)] + ["  ... (3 more entries omitted)"]
    coded = ["Findings:"] + [f"  [{'C' if i % 2 else '-'}] d{i}" for i in range(1, 16)] + ["  ... (2 more findings omitted)"]
    causes = ["Primary cause: wind", "Secondary cause: ice", "Occurrences:", "  1. LOSS (phase: CRUISE)", "  2. FIRE"]
    assert got == {
        "a": "\n".join(head + causes + sequence + coded + ["Injury: 1 fatal, 0 serious, 2 minor, 0 none. Aircraft damage: DEST."]),
        "b": "\n".join(head + ["Findings:"] + [f"  [F] e{i}" for i in range(1, 16)] + ["Aircraft damage: SUBS."]),
        "c": "\n".join(head + ["Sequence of events:", "  [occ 2] [C] only"]),
        "n": "\n".join(head + ["Sequence of events:"]),
        "p": "\n".join(head + ["Primary cause: fuel"]),
    }


def test_graph_takes_the_vocabulary_and_its_outcomes(spark):
    """Factors outside of the vocabulary make no edge; an outcome stays one however a node of it is classed."""
    chains = {"r1": ["ICE", "FAIL", "CRASH"], "r2": ["ICE", "other", "CRASH"], "r3": ["FAIL"], "r4": ["CRASH", "ICE"]}
    nodes = spark.createDataFrame([(r, i, "event", f) for r, c in chains.items() for i, f in enumerate(c)], "record_id string, idx int, class string, factor_type string")
    links = spark.createDataFrame([(r, i, 0, i - 1, "direct") for r, c in chains.items() for i in range(1, len(c))] + [("r1", 2, 1, 0, "direct")], "record_id string, dst_idx int, link_pos int, src_idx int, strength string")
    records = spark.createDataFrame([("r1", "A", 4), ("r2", "A", 3), ("r3", "A", 0), ("r4", "B", -1)], "record_id string, category string, sev_ordinal int")
    words = spark.createDataFrame([("ICE", False), ("FAIL", False), ("CRASH", True), ("unused", False)], "factor_type string, is_outcome boolean")
    given = {"nodes": nodes, "links": links, "records": records, "vocabulary": words}
    assert [tuple(r) for r in registry.apply("edge_support", spark, **given).collect()] == [("ICE", "FAIL", 1)]
    assert sorted(tuple(r) for r in registry.apply("outcome_edges", spark, **given).collect()) == [("FAIL", "CRASH", 1), ("ICE", "CRASH", 1)]
    assert sorted(tuple(r) for r in registry.apply("outcome_layer", spark, **given).collect()) == [("FAIL", 2, 0.5, 0.5, 1.0, "CRASH:1"), ("ICE", 3, 0.666667, 0.5, 1.333333, "CRASH:1")]
    assert registry.apply("kg_summary", spark, **given).first().n_factors == 2


def test_resampled_queries_run_the_whole_study(spark, sf_dir, monkeypatch):
    """30 redraws of networks, 500 redraws of every leading factor, 5 folds."""
    from causaloom.operators import noisyor, stats
    from causaloom.plans import custom

    steps = {round(r.stability * 30, 6) for r in custom.bootstrap_stability(spark, sf_dir).select("stability").collect()}
    assert all(s == int(s) for s in steps) and any(s % 3 for s in steps)
    fit, fold, asked = noisyor.fit_target, stats.classifier_out_of_fold, {}
    monkeypatch.setattr(noisyor, "fit_target", lambda *a, draws: asked.update(draws=draws, factors=len(a[3])) or fit(*a, draws=draws))
    monkeypatch.setattr(stats, "classifier_out_of_fold", lambda rows, features, kind="logistic", k=5: asked.update(k=k) or rows)
    got = custom.noisy_or_fit(spark, sf_dir).collect()
    custom.boosted_arm(spark, sf_dir)
    assert asked == {"draws": 500, "factors": registry.query("leading_factors")(spark, sf_dir).count(), "k": 5}
    assert len(got) == asked["factors"] + 1 and all(r.low <= r.high for r in got)
