"""Rules of both formats on records with known faults, and against a plain walk over random ones."""

import collections
import json
import random

from causaloom.operators import validate

SCHEMA = {
    "properties": {"outcome_severity": {"enum": ["fatal", "none"]}, "chain": {"type": "array"}, "note": {"oneOf": [{"enum": ["x"]}]}},
    "$defs": {
        "ChainNode": {"properties": {"class": {"enum": ["condition", "event", "outcome"]}, "factor_type": {"enum": ["A", "B", "CRASH"]}, "phase_of_flight": {"oneOf": [{"enum": ["cruise", "landing"]}, {"type": "null"}]}, "strength": {"enum": ["direct"]}, "idx": {"type": "integer"}}},
        "Event": {"properties": {"event_type": {"enum": ["E1", "E2"]}}}, "Edge": {"properties": {"type": {"enum": ["causes"]}}}, "Condition": {"properties": {"scope": {"enum": ["s"]}}},
    },
}
ENUMS = validate.schema_enums(json.dumps(SCHEMA))


def check(spark, records, **more):
    lines = [r if isinstance(r, str) else json.dumps(r) for r in records]
    return validate.validated(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), ENUMS, **more)


def test_value_lists_of_a_schema():
    assert ENUMS["ChainNode"]["phase_of_flight"] == ["cruise", "landing"] and "idx" not in ENUMS["ChainNode"] and ENUMS["_top"] == {"outcome_severity": ["fatal", "none"]}
    assert validate.schema_enums({}) == {}


def test_lines_and_formats(spark):
    rows = check(spark, ["{broken", "", "[1]", {"ok": False, "chain": [1]}, {"ok": None, "chain": []}, {"record_id": "a", "chain": []}, {"record_id": "b", "edges": []}, {"record_id": "c", "text": "x"}, {"ok": True, "record_id": "d", "chain": None}])
    assert [(r.state, r.format) for r in rows.collect()] == [("parse_error", None)] * 3 + [("not_ok", None)] * 2 + [("validated", "chain"), ("validated", "graph"), ("validated", "unknown"), ("validated", "chain")]
    assert validate.totals(rows).first().asDict() == {"n_lines": 9, "n_parse_errors": 3, "n_not_ok": 2, "n_validated": 4, "n_records_with_violations": 1}
    assert [(r.record_id, r.problems) for r in validate.flagged(rows).collect()] == [("c", ["unknown_format"])]


def walk_chain(rec):
    """The rules of chains, node by node."""
    out, chain, allowed = [], rec.get("chain") or [], ENUMS["ChainNode"]
    if rec.get("outcome_severity") is not None and rec["outcome_severity"] not in ENUMS["_top"]["outcome_severity"]:
        out.append("outcome_severity_oov")
    seen = []
    for pos, n in enumerate(chain):
        seen.append(n if isinstance(n, dict) else {})
        if not isinstance(n, dict):
            out.append("chain_item_not_object")
            continue
        out += ["idx_mismatch"] * (n.get("idx") != pos)
        for f, rule in (("class", "class_oov"), ("factor_type", "factor_type_oov"), ("phase_of_flight", "phase_oov")):
            out += [rule] * (n.get(f) is not None and n[f] not in allowed[f])
        for x in n.get("caused_by") or []:
            if not isinstance(x, dict):
                out.append("caused_by_not_object")
                continue
            src = x.get("src")
            out += ["strength_oov"] * (x.get("strength") not in (None, "direct"))
            if not isinstance(src, int) or not 0 <= src < len(chain):
                out.append("caused_by_out_of_range")
                continue
            out += ["caused_by_forward_reference"] * (src >= pos)
            if src <= pos:
                out += ["outcome_as_cause"] * (seen[src].get("class") == "outcome" and n.get("class") != "outcome")
                out += ["type_level_self_loop"] * (seen[src].get("factor_type") is not None and seen[src]["factor_type"] == n.get("factor_type"))
    return out


def walk_graph(rec):
    """The rules of graphs, node by node and edge by edge."""
    out, by_id, events = [], {}, 0
    for n in rec.get("nodes") or []:
        if not isinstance(n, dict):
            out.append("node_not_object")
            continue
        out += ["duplicate_node_id"] * (n.get("id") in by_id)
        by_id[n.get("id")] = n
        if n.get("kind") == "event":
            events += 1
            out += ["event_type_oov"] * (n.get("event_type") not in (None, "E1", "E2"))
        elif n.get("kind") == "condition":
            out += ["condition_scope_oov"] * (n.get("scope") not in (None, "s"))
        elif n.get("kind") != "entity":
            out.append("node_kind_invalid")
    out += ["too_many_events"] * (events > 20)
    for e in rec.get("edges") or []:
        if not isinstance(e, dict):
            out.append("edge_not_object")
            continue
        out += ["edge_type_oov"] * (e.get("type") not in (None, "causes"))
        a, b = by_id.get(e.get("src")), by_id.get(e.get("dst"))
        if a is None or b is None:
            out.append("edge_dangling_endpoint")
        elif a.get("kind") == b.get("kind") == "event" and a.get("event_type") == b.get("event_type"):
            out.append("type_level_self_loop")
    return out


def test_rules_against_a_plain_walk(spark):
    r = random.Random(1)
    some = lambda *values: r.choice(values)

    def chain(k):
        nodes = [some({"idx": some(i, i, i, 7, None), "class": some("event", "outcome", "condition", "odd", None), "factor_type": some("A", "B", "CRASH", "Z", None), "phase_of_flight": some("cruise", "hover", None),
                       "caused_by": some(None, [], [some({"src": some(0, 1, 2, -1, 9, i, None, 1.5), "strength": some("direct", "weak", None)}, 5) for _ in range(r.randint(0, 3))])}, "text", None, 4) if r.random() < 0.15
                 else {"idx": i, "class": some("event", "outcome"), "factor_type": some("A", "B", "CRASH"), "caused_by": [{"src": r.randint(0, 4), "strength": "direct"} for _ in range(r.randint(0, 2))]} for i in range(r.randint(0, 5))]
        return {"record_id": f"c{k}", "chain": nodes, "outcome_severity": some("fatal", "odd", None)}

    def graph(k):
        nodes = [some({"id": some("a", "b", "c", None, f"n{i}"), "kind": some("event", "entity", "condition", "odd", None), "event_type": some("E1", "E2", "E9", None), "scope": some("s", "t", None)}, {"id": f"n{i}", "kind": "event", "event_type": "E1"}, 3) for i in range(some(0, 2, 5, 25))]
        return {"record_id": f"g{k}", "nodes": nodes, "edges": [some({"src": some("a", "n0", "n1", None), "dst": some("b", "n1", "n9"), "type": some("causes", "odd")}, "x") for _ in range(r.randint(0, 4))]}

    records = [chain(k) for k in range(400)] + [graph(k) for k in range(300)]
    rows = check(spark, records)
    got = {x.record_id: sorted(p.rule for p in x.problems) for x in rows.collect()}
    want = {x["record_id"]: sorted(walk_chain(x) if "chain" in x else walk_graph(x)) for x in records}
    assert got == want
    every = collections.Counter(rule for v in want.values() for rule in v)
    assert len(every) == 20
    assert {x.rule: (x.n_places, x.n_records) for x in validate.rule_counts(rows).collect()} == {k: (n, sum(k in v for v in want.values())) for k, n in every.items()}
    top = [x for x in validate.values_outside(rows, most=2).collect() if x.rule == "type_level_self_loop"]
    assert [x.place for x in sorted(top, key=lambda x: x.place)] == [1, 2] and top[0].n >= 1
    assert validate.flagged(rows).count() == sum(bool(v) for v in want.values())
