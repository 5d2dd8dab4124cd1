"""Validation of extracted records against a JSON schema's value lists and the rules of their format.

A record is one line of JSON and stays one row: its nodes, links and edges are arrays, and
every rule is a higher-order expression over them, so a run has no join and no shuffle
until the report's counts.  A violation is (rule, value); rules do not stop at the first.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_EVENTS = 20
NODE = ("idx", "class", "factor_type", "cause_role", "phase_of_flight", "caused_by")
LINK = ("src", "strength")
OLD_NODE = ("id", "kind", "event_type", "haem", "cause_role", "phase_of_flight", "severity", "type", "scope")
OLD_EDGE = ("src", "dst", "type")
# Rule by field of the two formats.
CHAIN_FIELDS = {"class": "class_oov", "factor_type": "factor_type_oov", "cause_role": "cause_role_oov", "phase_of_flight": "phase_oov"}
EVENT_FIELDS = {"event_type": "event_type_oov", "haem": "haem_oov", "cause_role": "cause_role_oov", "phase_of_flight": "phase_oov", "severity": "severity_oov"}
CONDITION_FIELDS = {"type": "condition_type_oov", "scope": "condition_scope_oov"}

Enums = dict[str, dict[str, list[str]]]


def schema_enums(schema: str | dict) -> Enums:
    """{definition: {field: values}} of a JSON schema, those of its top level as ``_top``; values in ``oneOf`` branches count."""
    schema = json.loads(schema) if isinstance(schema, str) else schema

    def fields(definition: dict) -> dict[str, list[str]]:
        found = {}
        for name, kind in (definition.get("properties") or {}).items():
            if isinstance(kind, dict):
                values = kind.get("enum") or [v for branch in kind.get("oneOf") or [] if isinstance(branch, dict) for v in branch.get("enum") or []]
                if values:
                    found[name] = [str(v) for v in values if v is not None]
        return found

    found = {name: fields(definition) for name, definition in (schema.get("$defs") or {}).items()}
    top = {name: values for name, values in fields(schema).items() if "enum" in schema["properties"][name]}
    return found | ({"_top": top} if top else {})


def _violation(rule: str, value=None):
    return F.struct(F.lit(rule).alias("rule"), (F.lit(None) if value is None else value).cast("string").alias("value"))


def _if(condition, rule: str, value=None):
    """An array of one violation where ``condition`` holds, an empty one elsewhere."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(_violation(rule, value))).otherwise(F.array().cast("array<struct<rule:string,value:string>>"))


def _outside(value, allowed: list[str] | None, rule: str):
    return None if allowed is None else _if(value.isNotNull() & ~value.isin(*allowed), rule, value)


def _all(*checks):
    return F.concat(*[c for c in checks if c is not None])


def _object(text, fields: tuple[str, ...]):
    """A JSON object's fields as strings, null if the text is no object."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, ", ".join(f"`{f}` string" for f in fields)))


def _list(text):
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def _whole(text):
    """A number as an integer; null for anything else."""
    return F.when(text.rlike(r"^-?[0-9]{1,9}$"), text.cast("int"))


def _objects(text, fields: tuple[str, ...]):
    """The items of a JSON array as structs of strings, null for those that are no objects."""
    return F.transform(_list(text), lambda t: _object(t, fields))


def chain_nodes(chain):
    """The nodes of a chain (a JSON array) with their places and links as numbers and structs; to be bound to a column before its rules."""
    links = lambda n: F.transform(_objects(n["caused_by"], LINK), lambda x: F.when(x.isNotNull(), x.withField("at", _whole(x["src"]))))
    return F.transform(_objects(chain, NODE), lambda n: F.when(n.isNotNull(), n.withField("at", _whole(n["idx"])).withField("links", links(n))))


def graph_nodes(nodes):
    return _objects(nodes, OLD_NODE)


def graph_edges(edges):
    return _objects(edges, OLD_EDGE)


def chain_violations(nodes, severity, enums: Enums):
    """Violations of a chain, whose nodes cite earlier ones, as an array; ``nodes`` is a column of :func:`chain_nodes`."""
    allowed = enums.get("ChainNode", {})
    size = F.size(nodes)

    def link(n, pos, x):
        src = x["at"]
        inside = src.isNotNull() & (src >= 0) & (src < size)
        cited = F.when(inside & (src <= pos), F.get(nodes, src))
        place = F.concat(x["src"], F.lit(" at "), pos.cast("string"))
        own = _all(
            _outside(x["strength"], allowed.get("strength"), "strength_oov"), _if(~inside, "caused_by_out_of_range", place), _if(inside & (src >= pos), "caused_by_forward_reference", place),
            _if((cited["class"] == "outcome") & ~n["class"].eqNullSafe(F.lit("outcome")), "outcome_as_cause", place), _if(cited["factor_type"] == n["factor_type"], "type_level_self_loop", n["factor_type"]),
        )
        return F.when(x.isNull(), F.array(_violation("caused_by_not_object"))).otherwise(own)

    def node(n, pos):
        enum = [_outside(n[f], allowed.get(f), rule) for f, rule in CHAIN_FIELDS.items()]
        links = F.flatten(F.transform(n["links"], lambda x: link(n, pos, x)))
        own = _all(_if(~n["at"].eqNullSafe(pos), "idx_mismatch", F.concat(F.lit("position "), pos.cast("string"))), *enum, links)
        return F.when(n.isNull(), F.array(_violation("chain_item_not_object"))).otherwise(own)

    return _all(_outside(severity, enums.get("_top", {}).get("outcome_severity"), "outcome_severity_oov"), F.flatten(F.transform(nodes, node)))


def graph_violations(known, edges, enums: Enums, most_events: int = MOST_EVENTS):
    """Violations of the older format, nodes with ids and edges between them, as an array; columns of :func:`graph_nodes` and :func:`graph_edges`."""
    event, entity, condition, edge = (enums.get(name, {}) for name in ("Event", "Entity", "Condition", "Edge"))
    objects = F.filter(known, lambda n: n.isNotNull())

    def node(n, pos):
        of = lambda kind, *checks: F.when(n["kind"] == kind, _all(*checks, _if(F.lit(False), "none"))).otherwise(_if(F.lit(False), "none"))
        twice = F.exists(F.slice(known, 1, pos), lambda m: m.isNotNull() & m["id"].eqNullSafe(n["id"]))
        own = _all(
            _if(twice, "duplicate_node_id", n["id"]), of("event", *[_outside(n[f], event.get(f), rule) for f, rule in EVENT_FIELDS.items()]), of("entity", _outside(n["type"], entity.get("type"), "entity_type_oov")),
            of("condition", *[_outside(n[f], condition.get(f), rule) for f, rule in CONDITION_FIELDS.items()]), _if(~F.coalesce(n["kind"].isin("event", "entity", "condition"), F.lit(False)), "node_kind_invalid", F.coalesce(n["kind"], F.lit("None"))),
        )
        return F.when(n.isNull(), F.array(_violation("node_not_object"))).otherwise(own)

    def between(e):
        last = lambda end: F.try_element_at(F.filter(objects, lambda n: n["id"].eqNullSafe(e[end])), F.lit(-1))
        src, dst = last("src"), last("dst")
        same = (src["kind"] == "event") & (dst["kind"] == "event") & src["event_type"].eqNullSafe(dst["event_type"])
        own = _all(_outside(e["type"], edge.get("type"), "edge_type_oov"), _if(src.isNull() | dst.isNull(), "edge_dangling_endpoint", F.concat(F.coalesce(e["src"], F.lit("None")), F.lit("->"), F.coalesce(e["dst"], F.lit("None")))), _if(same, "type_level_self_loop", F.coalesce(src["event_type"], F.lit("None"))))
        return F.when(e.isNull(), F.array(_violation("edge_not_object"))).otherwise(own)

    events = F.size(F.filter(objects, lambda n: n["kind"] == "event"))
    return _all(F.flatten(F.transform(known, node)), _if(events > most_events, "too_many_events", events), F.flatten(F.transform(edges, between)))


def validated(lines: DataFrame, enums: Enums, text: str = "value", kind: str = "auto") -> DataFrame:
    """(record_id, state, format, problems) of every line of JSON.

    ``state`` is parse_error (no JSON object), not_ok (a false ``ok``) or validated; only validated
    records have a format (chain, graph or unknown; ``kind`` sets one for all) and problems.
    A format that is not known is a violation itself.
    """
    fields = F.from_json(F.col(text), "map<string,string>")
    given = lines.select(F.when(F.ltrim(text).startswith("{"), fields).alias("f"))
    at = lambda name: F.try_element_at("f", F.lit(name))
    bad = F.lower(at("ok")).isin("false", "0", "") | (F.map_contains_key("f", F.lit("ok")) & at("ok").isNull())
    state = F.when(F.col("f").isNull(), "parse_error").when(F.coalesce(bad, F.lit(False)), "not_ok").otherwise("validated")
    has = lambda name: F.map_contains_key("f", F.lit(name))
    form = F.when(has("chain"), "chain").when(has("nodes") | has("edges"), "graph").otherwise("unknown") if kind == "auto" else F.lit(kind)
    rows = given.select(at("record_id").alias("record_id"), state.alias("state"), F.when(state == "validated", form).alias("format"), *[at(c).alias(f"_{c}") for c in ("chain", "nodes", "edges", "outcome_severity")])
    rows = rows.select("record_id", "state", "format", "_outcome_severity", chain_nodes(F.col("_chain")).alias("_chain"), graph_nodes(F.col("_nodes")).alias("_nodes"), graph_edges(F.col("_edges")).alias("_edges"))
    problems = (
        F.when(F.col("format") == "chain", chain_violations(F.col("_chain"), F.col("_outcome_severity"), enums))
        .when(F.col("format") == "graph", graph_violations(F.col("_nodes"), F.col("_edges"), enums)).when(F.col("format") == "unknown", F.array(_violation("unknown_format")))
    )
    return rows.select("record_id", "state", "format", F.coalesce(problems, F.array().cast("array<struct<rule:string,value:string>>")).alias("problems"))


def rule_counts(checked: DataFrame) -> DataFrame:
    """(rule, n_places, n_records)."""
    first = lambda r, i: F.struct(r.alias("rule"), (F.array_position("rules", r) == i + 1).alias("first"))
    own = checked.select(F.col("problems")["rule"].alias("rules")).select(F.explode(F.transform("rules", first)).alias("c"))
    return own.groupBy("c.rule").agg(F.count("*").alias("n_places"), F.count_if("c.first").alias("n_records"))


def values_outside(checked: DataFrame, most: int = 25) -> DataFrame:
    """(rule, place, value, n): the ``most`` frequent values of each rule, ties by value."""
    counts = checked.select(F.explode("problems").alias("p")).filter("p.value IS NOT NULL AND (endswith(p.rule, '_oov') OR p.rule IN ('type_level_self_loop', 'node_kind_invalid'))").groupBy("p.rule", "p.value").agg(F.count("*").alias("n"))
    first = counts.groupBy("rule").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "value"))), 1, most).alias("top"))
    return first.select("rule", F.posexplode("top").alias("place", "t")).select("rule", (F.col("place") + 1).alias("place"), "t.value", (-F.col("t.less")).alias("n"))


def flagged(checked: DataFrame) -> DataFrame:
    """(record_id, problems) of the records with violations, as texts."""
    return checked.filter(F.size("problems") > 0).select("record_id", F.transform("problems", lambda p: F.concat_ws(": ", p["rule"], p["value"])).alias("problems"))


def totals(checked: DataFrame) -> DataFrame:
    """(n_lines, n_parse_errors, n_not_ok, n_validated, n_records_with_violations)."""
    of = lambda s: F.count_if(F.col("state") == s)
    return checked.agg(F.count("*").alias("n_lines"), of("parse_error").alias("n_parse_errors"), of("not_ok").alias("n_not_ok"), of("validated").alias("n_validated"), F.count_if(F.size("problems") > 0).alias("n_records_with_violations"))


def gold_states(answers: DataFrame, enums: Enums, raw: str = "raw", most: int = 5) -> DataFrame:
    """``answers`` with ``status`` (done or invalid) and ``problems``, the first ``most`` that count.

    An answer is one JSON object, a fence of backticks around it aside.  It is done if it has a
    chain that is not empty and no violation but factors that the vocabulary does not know, which do
    not count.  What is no object, also null, has the problem ``json parse error``.
    """
    names = [c for c in answers.columns if c not in ("status", "problems")]
    text = F.btrim(F.col(raw), F.lit(" \t\n\r\f\x0b"))
    bare = F.btrim(text, F.lit("`"))
    inner = F.when(text.startswith("```"), F.when(bare.startswith("json"), F.regexp_replace(bare, r"\A[^\n]*\n", "")).otherwise(bare)).otherwise(text)
    whole = F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<string>")
    item = F.when(F.size(whole) == 1, F.get(whole, F.lit(0)))
    rows = answers.select(*names, F.when(F.ltrim(item).startswith("{"), F.from_json(item, "map<string,string>")).alias("_f"))
    chain = F.try_element_at("_f", F.lit("chain"))
    rows = rows.select(*names, "_f", chain_nodes(F.when(F.ltrim(chain).startswith("["), chain)).alias("_nodes"))
    found = F.filter(chain_violations(F.col("_nodes"), F.try_element_at("_f", F.lit("outcome_severity")), enums), lambda p: p["rule"] != CHAIN_FIELDS["factor_type"])
    rows = rows.select(*names, "_f", "_nodes", found.alias("_hard"))
    told = F.when(F.col("_f").isNull(), F.array(F.lit("json parse error"))).otherwise(F.transform(F.slice("_hard", 1, most), lambda p: F.concat_ws(": ", p["rule"], p["value"])))
    done = F.col("_f").isNotNull() & (F.size("_hard") == 0) & (F.size("_nodes") > 0)
    return rows.select(*names, F.when(F.coalesce(done, F.lit(False)), "done").otherwise("invalid").alias("status"), told.alias("problems"))
