"""Links against a plain pooling of neighbours; states of gold answers; base rates of redraws; reports and tiers."""

import json

import numpy as np
import pytest

from causaloom.functions import vocab
from causaloom.operators import links, noisyor, validate
from causaloom.plans import catalog, registry  # noqa: F401  (catalog registers)


def pooled(x, y):
    """(scores, values) of the rising fit: neighbours that fall are pooled until none does."""
    at = sorted(set(x))
    blocks = [[np.mean([b for a, b in zip(x, y, strict=True) if a == s]), sum(a == s for a in x), 1] for s in at]
    k = 0
    while k < len(blocks) - 1:
        if blocks[k][0] >= blocks[k + 1][0]:
            (m, n, c), (q, o, e) = blocks[k], blocks.pop(k + 1)
            blocks[k] = [(m * n + q * o) / (n + o), n + o, c + e]
            k = max(0, k - 1)
        else:
            k += 1
    return at, [m for m, _, c in blocks for _ in range(c)]


def test_wind_scenarios_against_plain_pooling(spark):
    rng = np.random.default_rng(2)
    wind = rng.choice([0, 4, 8, 12, 18, 22, 27, 33, 38], 300).astype(float)
    gust, shear = (rng.random(300) < 0.1 + wind / 80).astype(int), (rng.random(300) < 0.3).astype(int)
    data = [(float(w), int(a), int(b)) for w, a, b in zip(wind, gust, shear, strict=True)]
    rows = spark.createDataFrame([*data, (None, 1, 1)], "wind_kts double, gust int, shear int")
    got = {(r.link, r.wind_kts): r for r in links.wind_scenarios(rows, rows).collect()}
    assert len(got) == 2 * len(links.WINDS)
    at, fitted = pooled((wind - 13).tolist(), shear.tolist())
    for w in links.WINDS:
        r = got["shear", w]
        assert (r.score, r.score_faster) == (w - 13, pytest.approx(w - (1.44 * 52 - 52)))
        assert (r.calibrated, r.calibrated_faster) == pytest.approx((np.interp(r.score, at, fitted), np.interp(r.score_faster, at, fitted))) and r.rescaled is None
    exceeded = spark.createDataFrame([(float(w),) for w in sorted(set(wind))], "w double").select("w", links.gust_exceedance("w", 65.0).alias("s")).collect()
    score = {r.w: r.s for r in exceeded}
    assert score[0.0] == 0 and all(a <= b for a, b in zip(list(score.values()), list(score.values())[1:], strict=False))
    at, fitted = pooled([score[w] for w in wind], gust.tolist())
    mean, share = np.mean([score[w] for w in wind]), (gust.sum() + 1) / 301
    for w in links.WINDS:
        r = got["gust", w]
        assert (r.calibrated, r.calibrated_faster) == pytest.approx((np.interp(r.score, at, fitted), np.interp(r.score_faster, at, fitted)))
        assert r.rescaled == pytest.approx(min(1, share * r.score / mean)) and r.score_faster <= r.score
    report = links.link_report(rows.selectExpr("monotonically_increasing_id() AS id", "wind_kts", "gust"), "wind_kts", "gust", "id").first()
    assert report.n == 300 and report.n_pos == gust.sum() and report.auc > 0.5 and 0 < report.brier < 0.25 and report.brier_base == pytest.approx(gust.mean() * (1 - gust.mean()))


def test_gold_states(spark):
    enums = validate.schema_enums({"$defs": {"ChainNode": {"properties": {"class": {"enum": ["event"]}, "factor_type": {"enum": ["ICE"]}}}}})
    node = {"idx": 0, "class": "event", "factor_type": "ICE", "caused_by": []}
    good = json.dumps({"chain": [node]})
    cases = [
        (good, "done", []), ("```json\n" + good + "\n```", "done", []), ("```" + good + "```", "done", []), (json.dumps({"chain": [node | {"factor_type": "NEW"}]}), "done", []),
        (json.dumps({"chain": [node | {"class": "x", "factor_type": "NEW"}]}), "invalid", ["class_oov: x"]), (json.dumps({"chain": []}), "invalid", []), (json.dumps({"chain": {"a": 1}}), "invalid", []), ("{}", "invalid", []),
        (None, "invalid", ["json parse error"]), ("", "invalid", ["json parse error"]), ("```json" + good + "```", "invalid", ["json parse error"]), ("[1]", "invalid", ["json parse error"]), (good + good, "invalid", ["json parse error"]),
        (json.dumps({"chain": [node | {"idx": 5}] * 7}), "invalid", [f"idx_mismatch: position {k}" for k in range(5)]),
    ]
    rows = spark.createDataFrame([(k, raw, "old") for k, (raw, *_) in enumerate(cases)], "key int, raw string, status string")
    got = {r.key: (r.status, r.problems) for r in validate.gold_states(rows, enums).collect()}
    assert got == {k: (status, problems) for k, (_, status, problems) in enumerate(cases)}


def test_base_rates_of_redraws(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random(600) < 0.3, rng.random(600) < 0.1
    y = rng.random(600) < 1 - 0.9 * np.where(a, 0.5, 1) * np.where(b, 0.7, 1)
    presence = spark.createDataFrame([(k, f) for k in range(600) for f, has in (("A", a[k]), ("B", b[k]), ("Y", y[k])) if has], "record_id int, factor_type string")
    got = noisyor.fit_target(presence, spark.range(600).selectExpr("CAST(id AS INT) AS record_id"), "Y", ["A", "B"], draws=200).set_index("factor")
    for name, x in (("A", a), ("B", b)):
        spread = 1.96 * np.sqrt(x.mean() * (1 - x.mean()) / 600)
        assert got.base[name] == pytest.approx(x.mean()) and got.base_low[name] == pytest.approx(x.mean() - spread, abs=0.012) and got.base_high[name] == pytest.approx(x.mean() + spread, abs=0.012)
    assert np.isnan(got.base["leak"]) and (got.low <= got.p + 1e-9).all() and (got.p <= got.high + 1e-9).all()


def test_tiers_and_gold_report(spark):
    presence = spark.createDataFrame([("r1", "STALL"), ("r2", "STALL"), ("r1", "FUEL_CONTAMINATION"), ("r3", "FATIGUE")], "record_id string, factor_type string")
    table = spark.createDataFrame([(f, *t) for f, t in vocab.TIERS.items()], "factor_type string, tier string, model string")
    got = {tuple(r) for r in registry.apply("factor_tiers", spark, causal_presence=presence, tier_table=table).collect()}
    assert got == {("STALL", "physics", "6-DOF", 2), ("FUEL_CONTAMINATION", "surrogate", "reliability", 1), ("FATIGUE", "data", None, 1)}
    gold = spark.createDataFrame([("a", "AAR", "ice", 2, 0, False), ("b", "AAR", "", 0, 1, False), ("c", "AAR", "x", 1, 1, True), ("d", None, None, 0, 0, False)], "record_id string, report_type string, probable_cause_text string, n_findings int, n_occurrences int, failed boolean")
    got = {tuple(r) for r in registry.apply("gold_report", spark, gold_records=gold).collect()}
    assert got == {(None, True, 4, 3, 1, 1, 1, 1), ("AAR", False, 3, 2, 1, 1, 1, 1), (None, False, 1, 1, 0, 0, 0, 0)}
