"""Texts for a model from packed records: the block of coded findings, the question and the whole conversation.

All are expressions over one row; a block is at most 30 entries and 15 findings long, as
the prompt's format has it, and says how many more there are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .enrich import BLANKS

# Fixed values of the prompt's format.
MOST_ENTRIES, MOST_FINDINGS = 30, 15
TITLE = "STRUCTURED FINDINGS (official investigation):"
LEVELS = ("fatal", "serious", "minor", "none")


def _said(text: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.btrim(text, F.lit(BLANKS)), F.lit(""))


def _section(title: str, rows: Column, lines: Column, most: int | None = None, what: str = "") -> Column:
    """Title and lines of an array, null if it is empty."""
    more = F.concat(F.lit("  ... ("), (F.size(rows) - (most or 0)).cast("string"), F.lit(f" more {what} omitted)"))
    rest = F.when(F.size(rows) > most, F.array(more)).otherwise(F.array().cast("array<string>")) if most else F.array().cast("array<string>")
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(F.lit(title)), F.array_compact(lines), rest), "\n"))


#: The fields of ``structured`` that the block tells.
FIELDS = ("primary_cause_text", "secondary_cause_text", "occurrences", "seq_of_events", "findings", "injury", "aircraft")


def supervision_text(structured: Column) -> Column:
    """The block of a payload of ``enrich``; null without causes, entries and findings."""
    cause, second = _said(structured["primary_cause_text"]), _said(structured["secondary_cause_text"])
    places, entries, findings = (F.coalesce(structured[c], F.array().cast(kind)) for c, kind in _kinds())
    flag = lambda x: F.coalesce(_said(x["cause_factor"]), F.lit("-"))

    def place(o, i):
        phase = _said(o["phase_text"])
        text = F.coalesce(F.btrim(F.coalesce(F.nullif(o["code_text"], F.lit("")), F.lit("?")), F.lit(BLANKS)), F.lit("?"))
        return F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), text, F.when(phase.isNull(), "").otherwise(F.concat(F.lit(" (phase: "), phase, F.lit(")"))))

    def entry(e):
        subject, modifier = _said(e["subj_text"]), _said(e["modifier_text"])
        line = F.concat(F.lit("  [occ "), F.coalesce(e["occurrence_no"].cast("string"), F.lit("None")), F.lit("] ["), flag(e), F.lit("] "), subject, F.when(modifier.isNull(), "").otherwise(F.concat(F.lit(" - "), modifier)))
        return F.when(subject != "None", line)

    def finding(f):
        return F.concat(F.lit("  ["), flag(f), F.lit("] "), F.btrim(F.coalesce(F.nullif(f["description"], F.lit("")), F.lit("?")), F.lit(BLANKS)))

    hurt = F.when(structured["injury"].isNotNull(), F.concat(F.lit("Injury: "), F.concat_ws(", ", *[F.concat(F.coalesce(structured["injury"][k], F.lit(0)).cast("string"), F.lit(f" {k}")) for k in LEVELS])))
    damage = F.concat(F.lit("Aircraft damage: "), _said(structured["aircraft"]["damage"]))
    last = F.nullif(F.concat_ws(". ", hurt, damage), F.lit(""))
    lines = [
        F.lit(TITLE), F.concat(F.lit("Primary cause: "), cause), F.concat(F.lit("Secondary cause: "), second), _section("Occurrences:", places, F.transform(places, place)),
        _section("Sequence of events:", entries, F.transform(F.slice(entries, 1, MOST_ENTRIES), entry), MOST_ENTRIES, "entries"),
        _section("Findings:", findings, F.transform(F.slice(findings, 1, MOST_FINDINGS), finding), MOST_FINDINGS, "findings"), F.concat(last, F.lit(".")),
    ]
    return F.when(cause.isNotNull() | (F.size(entries) > 0) | (F.size(findings) > 0), F.concat_ws("\n", *lines))


def _kinds():
    from .enrich import PAYLOAD

    return [(c, PAYLOAD[c]) for c in ("occurrences", "seq_of_events", "findings")]


def question(narrative: Column, block: Column | None = None) -> Column:
    """The narrative (null: empty) and, if there is one, its block."""
    told = F.concat(F.lit("NARRATIVE:\n"), F.coalesce(narrative, F.lit("")))
    return told if block is None else F.concat(told, F.when(block.isNull(), "").otherwise(F.concat(F.lit("\n\n"), block)))


def conversation(system: str, examples: list[dict], asked: Column) -> Column:
    """Messages (role, content) for a model: the instruction, worked examples (``user`` or ``narrative``, and ``extraction``), the question.

    The examples are part of every row, so they should be few.
    """
    said = [("system", system)]
    for e in examples:
        said += [("user", e.get("user") or f"NARRATIVE:\n{e['narrative']}"), ("assistant", json.dumps(e["extraction"]))]
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(*[message(r, F.lit(c)) for r, c in said], message("user", asked))


def gold_strings(entries: Column) -> Column:
    """Coded events (event, phase) as texts, the phase in brackets."""
    return F.transform(entries, lambda e: F.when(F.coalesce(e["phase"], F.lit("")) == "", e["event"]).otherwise(F.concat(e["event"], F.lit(" (phase: "), e["phase"], F.lit(")"))))
