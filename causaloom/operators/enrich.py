"""Coded supervision nested into records: one packed row a record, children as ordered arrays of structs.

A record finds its coded event by one of several paths: a key made of event and aircraft,
an accident number that a manifest knows, or a row of its own.  Tables of several
databases come as one table with a ``db`` column; ``pos`` is a row's place in its table.
Children are grouped by key, each with one shuffle, and joined by that same key, so
the joins move the records only.  Records without a key keep their id as one that matches
nothing, so that they spread over tasks like others.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["db", "ev_id", "aircraft_key"]
BLANKS = " \t\n\r\f\x0b"
# Injury levels, and the fields of the payload.
INJURY_LEVELS = {"FATL": "fatal", "SERS": "serious", "MINR": "minor", "NONE": "none"}
AIRCRAFT = ("make", "model", "damage", "num_eng", "category", "regis_no", "ntsb_no", "engine_make", "engine_model")
FINDING = "struct<code:string,description:string,category:string,cause_factor:string>"
OCCURRENCE = "struct<occurrence_code:bigint,code_text:string,phase_code:bigint,phase_text:string>"
ENTRY = "struct<order:bigint,occurrence_no:bigint,subj_code:bigint,subj_text:string,modifier_code:bigint,modifier_text:string,cause_factor:string,person_code:bigint>"
PAYLOAD = {
    "primary_cause_text": "string", "secondary_cause_text": "string", "additional_causes": "array<string>", "general_cause_category": "string",
    "findings": f"array<{FINDING}>", "occurrences": f"array<{OCCURRENCE}>", "seq_of_events": f"array<{ENTRY}>", "phase_of_flight": "string",
    "flying_condition": "string", "light_condition": "string", "event_type": "string", "severity": "string",
    "aircraft": "struct<" + ",".join(f"{c}:string" for c in AIRCRAFT) + ">", "injury": "struct<fatal:bigint,serious:bigint,minor:bigint,none:bigint>",
    "ntsb_accident_id": "string", "report_type": "string", "txt_path": "string",
}
#: The fields that need a child.
NEEDED_BY = {"findings": {"findings", "primary_cause_text"}, "occurrences": {"occurrences", "phase_of_flight"}, "seq_of_events": {"seq_of_events", "primary_cause_text"}, "injury": {"injury"}, "_aircraft": {"aircraft"}}


@dataclass(frozen=True)
class Paths:
    """How sources find supervision, and what each way is called.

    ``keyed``: source -> (database, name); its record ids are ``<event>_<aircraft>``.  ``reports``
    is the source whose ids the manifest lists; accident numbers are looked up in ``databases``
    in this order.  Sources that start with ``coded`` have rows of their own.
    """

    keyed: dict[str, tuple[str, str]] = field(default_factory=lambda: {"NTSB_ASRS:Pre2008": ("Pre2008", "NTSB_eADMS_Pre2008"), "NTSB_ASRS:avall": ("avall", "NTSB_eADMS_avall")})
    databases: tuple[str, ...] = ("Pre2008", "avall")
    reports: str = "NTSB_REPORT"
    by_number: str = "NTSB_REPORT_via_ntsb_no"
    manifest_only: str = "NTSB_REPORT_manifest_only"
    coded: str = "FAA_AIDS:"
    coded_name: str = "FAA_AIDS"


def code_texts(codes: DataFrame) -> DataFrame:
    """(code, meaning) of (code, meaning, pos): the last meaning that is not empty, else an empty one."""
    said = F.col("meaning") != ""
    return codes.filter("code IS NOT NULL").groupBy(F.col("code").cast("long").alias("code")).agg(F.coalesce(F.max_by(F.when(said, F.col("meaning")), F.when(said, F.col("pos"))), F.lit("")).alias("meaning"))


def _with_text(rows: DataFrame, texts: DataFrame, code: str, name: str) -> DataFrame:
    known = texts.select(F.col("code").alias("_code"), F.col("meaning").alias(name))
    return rows.join(known, F.col(code).cast("long") == F.col("_code"), "left").drop("_code")


def _last(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The last row of each key, as one struct ``v``."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "pos").alias("v"))


def _listed(rows: DataFrame, kind: str, name: str, order: list, fields: dict[str, Column]) -> DataFrame:
    """(key, name): the rows of a key as structs in order."""
    item = F.struct(*[c.alias(n) for n, c in fields.items()]).cast(kind)
    packed = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], item.alias("item"))))
    return rows.groupBy(*KEY).agg(packed.alias("_l")).select(*KEY, F.transform("_l", lambda x: x["item"]).alias(name))


def children(tables: dict[str, DataFrame], databases: tuple[str, ...]) -> dict[str, DataFrame]:
    """The nested children by key: findings and occurrences in the order of their tables, sequence entries by occurrence, number and place, and persons hurt by level."""
    own = {name: rows.filter(F.col("db").isin(*databases)) for name, rows in tables.items() if "db" in rows.columns}
    # of the records' type: else the joins, which compare casts, would move the grouped children again
    own = {name: rows.withColumn("aircraft_key", F.col("aircraft_key").cast("long")) if "aircraft_key" in rows.columns else rows for name, rows in own.items()}
    texts = code_texts(tables["codes"])
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    places = _with_text(_with_text(own["occurrences"], texts, "occurrence_code", "code_text"), texts, "phase_code", "phase_text")
    entries = _with_text(_with_text(own["sequence"], texts, "subj_code", "subj_text"), texts, "modifier_code", "modifier_text")
    at = lambda *names: {n: F.col(n) for n in names}
    hurt = lambda level: F.sum(F.when(F.upper("injury_level") == level, zero("persons")).otherwise(0))
    injury = own["injuries"].groupBy(*KEY).agg(F.struct(*[hurt(code).alias(name) for code, name in INJURY_LEVELS.items()]).alias("injury"))
    return {
        "findings": _listed(own["findings"], FINDING, "findings", [F.col("pos")], at("code", "description", "category", "cause_factor")),
        "occurrences": _listed(places, OCCURRENCE, "occurrences", [F.col("pos")], at("occurrence_code", "code_text", "phase_code", "phase_text")),
        "seq_of_events": _listed(entries, ENTRY, "seq_of_events", [zero("occurrence_no"), zero("seq_event_no"), F.col("pos")],
                                 {"order": F.col("seq_event_no")} | at("occurrence_no", "subj_code", "subj_text", "modifier_code", "modifier_text", "cause_factor", "person_code")),
        "injury": injury,
        "_aircraft": _last(own["aircraft"], KEY, list(AIRCRAFT[:7])).withColumnRenamed("v", "_aircraft"),
    }


def accident_numbers(aircraft: DataFrame, databases: tuple[str, ...]) -> DataFrame:
    """(number, hit): the aircraft of an accident number, in the first database that has it the last row; blank numbers are none."""
    rank = F.array_position(F.array(*[F.lit(d) for d in databases]), F.col("db"))
    named = aircraft.select(F.btrim("ntsb_no", F.lit(BLANKS)).alias("number"), rank.alias("rank"), "pos", F.struct(*KEY).alias("hit"))
    return named.filter("rank > 0 AND number <> ''").groupBy("number").agg(F.min_by("hit", F.struct("rank", -F.col("pos"))).alias("hit"))


def split_key(record_id: Column) -> tuple[Column, Column]:
    """(event, aircraft) of ``<event>_<aircraft>``, split at the last underscore; the aircraft is null if it is no whole number."""
    event = F.regexp_extract(record_id, r"(?s)^(.*)_([^_]*)$", 1)
    number = F.regexp_extract(record_id, r"(?s)^(.*)_\s*([+-]?[0-9]+)\s*$", 2)
    return event, F.when(number != "", number.try_cast("long"))


def primary_cause(findings: Column, entries: Column) -> Column:
    """The first finding flagged C or F, whatever its text; without one the subject of the first entry flagged C."""
    flagged = F.filter(findings, lambda f: F.upper(f["cause_factor"]).isin("C", "F"))
    subject = F.get(F.filter(entries, lambda e: F.upper(e["cause_factor"]) == "C"), F.lit(0))["subj_text"]
    return F.when(F.size(flagged) > 0, F.get(flagged, F.lit(0))["description"]).when(subject != "", subject)


def _payload(fields: Collection[str], **given: Column) -> Column:
    return F.struct(*[(given.get(name, F.lit(None)) if name in fields else F.lit(None)).cast(kind).alias(name) for name, kind in PAYLOAD.items()])


def _coded_payload(fields: Collection[str], row: Column) -> Column:
    """Supervision of a source that codes its records itself."""
    killed = F.upper(F.btrim(row["pilot_killed_flag"], F.lit(BLANKS))).isin("Y", "1", "T")
    kind = F.upper(row["event_type"])
    severity = F.when(killed, "fatal").when(kind == "A", "accident").when(kind == "I", "incident")
    more = F.filter(F.array(row["cause_additional_text"], row["cause_2nd_additional_text"]), lambda c: c != "")
    craft = {"make": "aircraft_make", "model": "aircraft_model", "engine_make": "engine_make", "engine_model": "engine_model"}
    return _payload(
        fields, primary_cause_text=row["cause_primary_text"], secondary_cause_text=row["cause_secondary_text"], additional_causes=more, general_cause_category=row["cause_general_category_text"],
        phase_of_flight=row["phase_of_flight_text"], flying_condition=row["flying_condition_primary"], light_condition=row["light_condition_text"], event_type=F.nullif(kind, F.lit("")), severity=severity,
        aircraft=F.struct(*[(row[craft[c]] if c in craft else F.lit(None)).cast("string").alias(c) for c in AIRCRAFT]),
    )


def enriched(records: DataFrame, tables: dict[str, DataFrame], manifest: DataFrame, coded: DataFrame, paths: Paths = Paths(), fields: Collection[str] = PAYLOAD) -> DataFrame:
    """``records`` (record_id, source, any others) with ``structured`` and ``supervision_source``, both null where no path leads anywhere.

    ``tables``: events (db, ev_id, ev_type), aircraft, findings, occurrences, sequence, injuries
    (each by db, ev_id and aircraft_key) and codes.  A well-formed key has a payload even if no table knows
    it, one of empty lists.  A report without a known accident number has what the manifest
    says.  Of rows that share an id in ``events``, ``aircraft``, ``manifest`` or ``coded`` the last counts;
    repeated records stay.  Null ids and sources have no supervision.  Columns of the
    records may have any names but those two and such that start with ``_enrich``.
    ``fields`` names the fields of ``structured`` that are wanted: the others are null, and children that
    only they need are neither grouped nor joined.
    """
    own = list(records.columns)
    rows = records.select(F.struct(*own).alias("_enrich"), F.col("record_id").cast("string").alias("_id"), F.col("source").alias("_source"))
    papers = _last(manifest, ["report_number"], ["ntsb_accident_id", "report_type", "txt_path"]).withColumnRenamed("v", "_paper")
    numbered = papers.select("report_number", F.btrim("_paper.ntsb_accident_id", F.lit(BLANKS)).alias("number")).filter("number <> ''")
    hits = numbered.join(accident_numbers(tables["aircraft"], paths.databases), "number").select(F.col("report_number").alias("_hit_of"), F.col("hit").alias("_hit"))
    known = _last(coded, ["record_id"], [c for c in coded.columns if c not in ("record_id", "pos")]).select(F.col("record_id").alias("_known_as"), F.col("v").alias("_coded"))
    report = F.col("_source") == paths.reports
    rows = rows.join(papers, (F.col("_id") == F.col("report_number")) & report, "left").join(hits, (F.col("_id") == F.col("_hit_of")) & report, "left")
    rows = rows.join(known, (F.col("_id") == F.col("_known_as")) & F.startswith("_source", F.lit(paths.coded)), "left")

    event, aircraft = split_key(F.col("_id"))
    base = F.lit(None).cast("string")
    database = name = base
    for source, (db, called) in paths.keyed.items():
        database = F.when(F.col("_source") == source, db).otherwise(database)
        name = F.when(F.col("_source") == source, called).otherwise(name)
    direct = database.isNotNull() & aircraft.isNotNull()
    found = F.coalesce(direct, F.lit(False)) | F.col("_hit").isNotNull()
    rows = rows.select(
        "_enrich", "_paper", "_coded", found.alias("_found"), F.when(direct, name).when(F.col("_hit").isNotNull(), paths.by_number).alias("_name"),
        F.when(direct, database).when(found, F.col("_hit.db")).otherwise("").alias("db"), F.when(direct, event).when(found, F.col("_hit.ev_id")).otherwise(F.col("_id")).alias("ev_id"),
        F.when(direct, aircraft).when(found, F.col("_hit.aircraft_key").cast("long")).otherwise(-1).alias("aircraft_key"),
    )
    if "event_type" in fields:
        events = _last(tables["events"].filter(F.col("db").isin(*paths.databases)), ["db", "ev_id"], ["ev_type"]).withColumnRenamed("v", "_event")
        rows = rows.join(events, ["db", "ev_id"], "left")
    else:
        rows = rows.withColumn("_event", F.lit(None).cast("struct<ev_type:string>"))
    for name, child in children(tables, paths.databases).items():
        if NEEDED_BY[name].isdisjoint(fields):  # a key has one row there, so rows stay as they are
            rows = rows.withColumn(name, F.lit(None).cast(child.schema[name].dataType))
        else:
            rows = rows.join(child, KEY, "left")

    lists = {c: F.coalesce(F.col(c), F.array().cast(PAYLOAD[c])) for c in ("findings", "occurrences", "seq_of_events")}
    phases = F.filter(lists["occurrences"], lambda o: (o["phase_code"] != 0) & (o["phase_text"] != ""))
    craft = F.when(F.col("_aircraft").isNotNull(), F.struct(*[(F.col(f"_aircraft.{c}") if c in AIRCRAFT[:7] else F.lit(None)).cast("string").alias(c) for c in AIRCRAFT]))
    full = _payload(
        fields, primary_cause_text=primary_cause(lists["findings"], lists["seq_of_events"]), phase_of_flight=F.get(phases, F.lit(0))["phase_text"], aircraft=craft, injury=F.col("injury"),
        event_type=F.when(F.col("_event").isNotNull(), F.upper(F.coalesce("_event.ev_type", F.lit("")))), **lists,
    )
    paper = _payload(fields, **{c: F.col(f"_paper.{c}") for c in ("ntsb_accident_id", "report_type", "txt_path")})
    has = lambda c: F.col(c).isNotNull()
    structured = F.when(F.col("_found"), full).when(has("_paper"), paper).when(has("_coded"), _coded_payload(fields, F.col("_coded")))
    called = F.when(F.col("_found"), F.col("_name")).when(has("_paper"), paths.manifest_only).when(has("_coded"), paths.coded_name)
    return rows.select("_enrich.*", structured.alias("structured"), called.alias("supervision_source"))


def coverage(rows: DataFrame) -> DataFrame:
    """(source, n, with_structured, with_primary_cause) of enriched records."""
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("structured").alias("with_structured"), F.count_if(F.col("structured.primary_cause_text") != "").alias("with_primary_cause"))
