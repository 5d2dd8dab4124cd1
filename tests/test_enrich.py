"""Nested enrichment against a plain loop over random tables; prompt texts line by line."""

import random

import pytest
from pyspark.sql import functions as F

from causaloom.operators import enrich, prompts

PATHS = enrich.Paths(keyed={"old": ("A", "old_coded"), "new": ("B", "new_coded")}, databases=("A", "B"), reports="report", by_number="by_number", manifest_only="paper", coded="own:", coded_name="own")
SCHEMAS = {
    "codes": "code long, meaning string, pos long", "events": "db string, ev_id string, ev_type string, pos long",
    "aircraft": "db string, ev_id string, aircraft_key int, make string, model string, damage string, num_eng int, category string, regis_no string, ntsb_no string, pos long",
    "findings": "db string, ev_id string, aircraft_key int, code string, description string, category string, cause_factor string, pos long",
    "occurrences": "db string, ev_id string, aircraft_key int, occurrence_code long, phase_code long, pos long",
    "sequence": "db string, ev_id string, aircraft_key int, occurrence_no int, seq_event_no int, subj_code long, modifier_code long, cause_factor string, person_code long, pos long",
    "injuries": "db string, ev_id string, aircraft_key int, injury_level string, persons int, pos long",
    "manifest": "report_number string, ntsb_accident_id string, report_type string, txt_path string, pos long",
    "coded": "record_id string, cause_primary_text string, cause_secondary_text string, cause_additional_text string, cause_2nd_additional_text string, cause_general_category_text string, phase_of_flight_text string,"
             " flying_condition_primary string, light_condition_text string, event_type string, aircraft_make string, aircraft_model string, engine_make string, engine_model string, pilot_killed_flag string, pos long",
    "records": "record_id string, source string, make string, db string",
}


def random_tables(r):
    key = lambda: (r.choice("ABC"), r.choice(["e1", "e_2", "e3", None]), r.choice([1, 2, None]))
    flag = lambda: r.choice(["C", "f", "", None, "c"])
    code = lambda: r.choice([0, 1, 2, 3, 9, None])
    text = lambda: r.choice(["t1", "t2", "", None])
    return {
        "codes": [(code(), r.choice(["M1", "M2", "", None]), i) for i in range(8)],
        "events": [(*key()[:2], r.choice(["acc", "INC", None]), i) for i in range(14)],
        "aircraft": [(*key(), *[text() for _ in range(3)], r.choice([1, None]), text(), text(), r.choice([" N1 ", "N2", "N3", " ", None]), i) for i in range(16)],
        "findings": [(*key(), text(), text(), text(), flag(), i) for i in range(24)],
        "occurrences": [(*key(), code(), code(), i) for i in range(24)],
        "sequence": [(*key(), r.choice([None, 1, 2]), r.choice([None, 1, 2]), code(), code(), flag(), code(), i) for i in range(30)],
        "injuries": [(*key(), r.choice(["FATL", "sers", "MINR", "NONE", "X", None]), r.choice([1, 5, None]), i) for i in range(24)],
        "manifest": [(r.choice(["r1", "r2", "r3", "r4", None]), r.choice(["N1", " N2", "N3", "N9", " ", None]), text(), text(), i) for i in range(6)],
        "coded": [(r.choice(["f1", "f2", "f3"]), *[text() for _ in range(8)], r.choice(["A", "i", "", None]), *[text() for _ in range(4)], r.choice([" y", "1", "N", None]), i) for i in range(4)],
        "records": [(f"{e}_{k}", s, "own", "mine") for e in ("e1", "e_2", "e3", "e4") for k in ("1", " 2 ", "x", "") for s in ("old", "new", "other")]
        + [(k, "report", "own", None) for k in ("r1", "r2", "r3", "r4", "r5")] + [(k, s, None, None) for k in ("f1", "f2", "f3", "f9") for s in ("own:a", "own")] + [(None, "old", "z", "z"), ("e1_1", None, "z", "z"), ("e1_1", "old", "own", "mine"), ("e1", "old", "", "")],
    }


def plain(t):
    """What every record of the tables should get, record by record."""
    names = {n: [f.split()[0] for f in s.split(", ")] for n, s in SCHEMAS.items()}
    names["coded"] = [f.split()[0] for f in SCHEMAS["coded"].split(",")]
    rows = {n: [dict(zip(names[n], row, strict=True)) for row in t[n]] for n in t}
    meanings = {}
    for c in rows["codes"]:
        if c["code"] is not None:
            meanings[c["code"]] = c["meaning"] or meanings.get(c["code"], "")
    papers = {m["report_number"]: m for m in rows["manifest"]}
    own = {c["record_id"]: c for c in rows["coded"]}

    def of(name, db, ev, ak=None):
        return [x for x in rows[name] if x["db"] == db and x["ev_id"] == ev and ev is not None and (ak is None or x["aircraft_key"] == ak)]

    def packed(db, ev, ak):
        events, craft, findings = of("events", db, ev), of("aircraft", db, ev, ak), of("findings", db, ev, ak)
        places, hurt = of("occurrences", db, ev, ak), of("injuries", db, ev, ak)
        entries = sorted(of("sequence", db, ev, ak), key=lambda x: (x["occurrence_no"] or 0, x["seq_event_no"] or 0))
        phases = [meanings[o["phase_code"]] for o in places if o["phase_code"] and meanings.get(o["phase_code"])]
        flagged, cited = [f for f in findings if (f["cause_factor"] or "").upper() in ("C", "F")], [e for e in entries if (e["cause_factor"] or "").upper() == "C"]
        levels = dict.fromkeys(enrich.INJURY_LEVELS.values(), 0)
        for h in hurt:
            if (h["injury_level"] or "").upper() in enrich.INJURY_LEVELS:
                levels[enrich.INJURY_LEVELS[h["injury_level"].upper()]] += h["persons"] or 0
        return {
            "event_type": (events[-1]["ev_type"] or "").upper() if events else None, "phase_of_flight": phases[0] if phases else None, "injury": levels if hurt else None,
            "aircraft": {c: None if craft[-1].get(c) is None else str(craft[-1][c]) for c in enrich.AIRCRAFT} if craft else None,
            "primary_cause_text": flagged[0]["description"] if flagged else (meanings.get(cited[0]["subj_code"]) or None) if cited else None,
            "findings": [{k: f[k] for k in ("code", "description", "category", "cause_factor")} for f in findings],
            "occurrences": [{"occurrence_code": o["occurrence_code"], "code_text": meanings.get(o["occurrence_code"]), "phase_code": o["phase_code"], "phase_text": meanings.get(o["phase_code"])} for o in places],
            "seq_of_events": [{"order": e["seq_event_no"], "occurrence_no": e["occurrence_no"], "subj_code": e["subj_code"], "subj_text": meanings.get(e["subj_code"]), "modifier_code": e["modifier_code"],
                               "modifier_text": meanings.get(e["modifier_code"]), "cause_factor": e["cause_factor"], "person_code": e["person_code"]} for e in entries],
        }

    numbers = {}
    for a in rows["aircraft"]:
        number = (a["ntsb_no"] or "").strip()
        if number and a["db"] in "AB":
            numbers.setdefault(number, {})[a["db"]] = (a["db"], a["ev_id"], a["aircraft_key"])
    done = []
    for rec in rows["records"]:
        rid, source, payload, called = rec["record_id"], rec["source"], None, None
        if source in PATHS.keyed and rid and "_" in rid:
            ev, ak = rid.rsplit("_", 1)
            if ak.strip().isdigit():
                payload, called = packed(PATHS.keyed[source][0], ev, int(ak)), PATHS.keyed[source][1]
        elif source == "report" and rid in papers:
            hit = numbers.get((papers[rid]["ntsb_accident_id"] or "").strip(), {})
            if hit:
                payload, called = packed(*(hit.get("A") or hit["B"])), "by_number"
            else:
                payload, called = {c: papers[rid][c] for c in ("ntsb_accident_id", "report_type", "txt_path")}, "paper"
        elif (source or "").startswith("own:") and rid in own:
            c = own[rid]
            severity = "fatal" if (c["pilot_killed_flag"] or "").strip().upper() in ("Y", "1", "T") else {"A": "accident", "I": "incident"}.get((c["event_type"] or "").upper())
            payload, called = {
                "primary_cause_text": c["cause_primary_text"], "secondary_cause_text": c["cause_secondary_text"], "additional_causes": [x for x in (c["cause_additional_text"], c["cause_2nd_additional_text"]) if x],
                "general_cause_category": c["cause_general_category_text"], "phase_of_flight": c["phase_of_flight_text"], "flying_condition": c["flying_condition_primary"], "light_condition": c["light_condition_text"],
                "event_type": (c["event_type"] or "").upper() or None, "severity": severity,
                "aircraft": dict.fromkeys(enrich.AIRCRAFT) | {"make": c["aircraft_make"], "model": c["aircraft_model"], "engine_make": c["engine_make"], "engine_model": c["engine_model"]},
            }, "own"
        done.append((rid, source, rec["make"], rec["db"], None if payload is None else dict.fromkeys(enrich.PAYLOAD) | payload, called))
    return done


def frames(spark, t):
    made = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in t.items()}
    return made.pop("records"), made, made.pop("manifest"), made.pop("coded")


@pytest.mark.parametrize("seed", range(4))
def test_enriched_against_a_plain_loop(spark, seed):
    t = random_tables(random.Random(seed))
    out = enrich.enriched(*frames(spark, t), PATHS)
    assert out.columns == ["record_id", "source", "make", "db", "structured", "supervision_source"]
    got = [(r.record_id, r.source, r.make, r.db, None if r.structured is None else r.structured.asDict(True), r.supervision_source) for r in out.collect()]
    want = plain(t)
    assert sorted(got, key=str) == sorted(want, key=str)
    counts = {r.source: (r.n, r.with_structured, r.with_primary_cause) for r in enrich.coverage(out).collect()}
    for source in {w[1] for w in want}:
        own = [w for w in want if w[1] == source]
        assert counts[source] == (len(own), sum(w[4] is not None for w in own), sum(bool(w[4] and w[4]["primary_cause_text"]) for w in own))
    assert {w[5] for w in want} >= {"old_coded", "new_coded", "own", None}


def test_children_are_moved_once_and_only_those_that_are_wanted(spark):
    """Grouped children join where they are, and a field that is not wanted moves nothing."""
    t = random_tables(random.Random(2))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        whole, some = enrich.enriched(*frames(spark, t), PATHS), enrich.enriched(*frames(spark, t), PATHS, fields=["primary_cause_text"])
        plan, less = (x._jdf.queryExecution().executedPlan().toString() for x in (whole, some))
        moved = [x for x in plan.split("\n") if "Exchange" in x]
        assert any("aircraft_key" in x for x in moved) and not any("cast(aircraft_key" in x for x in moved)
        assert "injury_level" in plan and "injury_level" not in less and less.count("Exchange") < len(moved) - 4
        want = [(r.record_id, r.supervision_source, r.structured and r.structured.primary_cause_text) for r in whole.collect()]
        got = [(r.record_id, r.supervision_source, r.structured and r.structured.primary_cause_text) for r in some.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert all(v is None for r in some.collect() if r.structured for k, v in r.structured.asDict().items() if k != "primary_cause_text")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_enriched_of_empty_tables(spark):
    t = random_tables(random.Random(9))
    empty = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    records, tables, manifest, coded = frames(spark, t)
    assert enrich.enriched(empty["records"], tables, manifest, coded, PATHS).count() == 0
    out = enrich.enriched(records, {n: empty[n] for n in tables}, empty["manifest"], empty["coded"], PATHS).collect()
    assert len(out) == len(t["records"]) and {r.supervision_source for r in out} == {"old_coded", "new_coded", None}
    assert all(r.structured.findings == [] and r.structured.injury is None for r in out if r.structured)


def payload(spark, **given):
    kinds = ", ".join(f"{c}: {k}" for c, k in enrich.PAYLOAD.items())
    row = tuple(given.get(c) for c in enrich.PAYLOAD)
    return spark.createDataFrame([(1, row), (2, None)], f"id int, s struct<{kinds}>").withColumn("block", prompts.supervision_text(F.col("s")))


def test_supervision_text(spark):
    entries = [(i, None if i == 3 else 1, 5, "None" if i == 2 else f"s{i}", 6, "m " if i == 1 else None, "C" if i == 1 else " ", None) for i in range(1, 33)]
    findings = [(None, f"d{i}" if i != 2 else "", None, "F" if i == 1 else None) for i in range(1, 17)]
    craft = (None, None, " DEST ", *[None] * 6)
    rows = payload(spark, primary_cause_text=" wind ", secondary_cause_text="\n", findings=findings, seq_of_events=entries, occurrences=[(1, " LOSS", 2, "CRUISE "), (1, None, 2, "")], injury=(1, None, 0, 2), aircraft=craft)
    got = {r.id: r.block for r in rows.collect()}
    want = ["STRUCTURED FINDINGS (official investigation):", "Primary cause: wind", "Occurrences:", "  1. LOSS (phase: CRUISE)", "  2. ?", "Sequence of events:", "  [occ 1] [C] s1 - m", "  [occ None] [-] s3"]
    want += [f"  [occ 1] [-] s{i}" for i in range(4, 31)] + ["  ... (2 more entries omitted)", "Findings:", "  [F] d1", "  [-] ?"] + [f"  [-] d{i}" for i in range(3, 16)] + ["  ... (1 more findings omitted)"]
    assert got == {1: "\n".join([*want, "Injury: 1 fatal, 0 serious, 0 minor, 2 none. Aircraft damage: DEST."]), 2: None}
    assert {r.block for r in payload(spark, occurrences=[(1, "LOSS", 2, "")], injury=(1, 0, 0, 0)).collect()} == {None}
    assert payload(spark, primary_cause_text="fuel").first().block.endswith(":\nPrimary cause: fuel")


def test_conversations(spark):
    rows = spark.createDataFrame([(1, "It fell.", "BLOCK"), (2, None, None)], "id int, text string, block string")
    examples = [{"user": "U", "extraction": {"chain": []}}, {"narrative": "n", "extraction": [1]}]
    asked = rows.select("id", prompts.conversation("be brief", examples, prompts.question(F.col("text"), F.col("block"))).alias("m"), prompts.question(F.col("text")).alias("q")).orderBy("id").collect()
    head = [("system", "be brief"), ("user", "U"), ("assistant", '{"chain": []}'), ("user", "NARRATIVE:\nn"), ("assistant", "[1]")]
    assert [tuple(m) for m in asked[0].m] == [*head, ("user", "NARRATIVE:\nIt fell.\n\nBLOCK")] and asked[1].m[-1].content == "NARRATIVE:\n" and asked[0].q == "NARRATIVE:\nIt fell."
    gold = spark.createDataFrame([([("fire", "climb"), ("stall", ""), ("spin", None)],)], "e array<struct<event:string,phase:string>>")
    assert gold.select(prompts.gold_strings(F.col("e")).alias("g")).first().g == ["fire (phase: climb)", "stall", "spin"]
