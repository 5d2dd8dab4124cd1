"""Answers in the older format, nodes and typed edges between them: a strict parse and the pairs that lead to one another.

A record stays one row: its nodes and edges are arrays, every check is a higher-order
expression, and no shuffle is needed before pairs are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .enrich import BLANKS
from .validate import OLD_EDGE, OLD_NODE

# Edges that say that one end comes before the other.
LEADING = ("CAUSES", "CONTRIBUTES_TO", "TRIGGERS", "ENABLES", "PRECEDES")
FENCE = "```"


def _parts(text: Column) -> Column:
    """The items of a JSON array as texts, null if the text is none."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def outermost_object(raw: Column) -> Column:
    """From the first brace to the last, a fence around it taken off; null without braces."""
    text = F.btrim(raw, F.lit(BLANKS))
    inner = F.regexp_replace(text, r"(?s)\A```[^\n]*(?:\n|\z)", "")
    open_ = F.when(text.startswith(FENCE), F.regexp_replace(inner, r"(?s)```\z", "")).otherwise(text)
    return F.nullif(F.regexp_extract(open_, r"(?s)(\{.*\})", 1), F.lit(""))


def _listed(text: Column) -> Column:
    """An array's items as texts; none for what is absent or empty in any way; null for anything else."""
    empty = F.coalesce(text, F.lit("null")).isin("null", "", "0", "0.0", "false", "{}")
    return F.when(empty, F.array().cast("array<string>")).otherwise(_parts(text))


def _object(text: Column, fields: tuple[str, ...]) -> Column:
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, ", ".join(f"`{f}` string" for f in fields)))


def parsed(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """``answers`` with ``nodes`` and ``edges`` (arrays of structs, null items for nodes that are no objects) or else an ``error``.

    Errors, the first that applies: ``no object``, ``invalid json`` (also text between two
    objects), ``nodes or edges not arrays``, then for the first edge that is wrong ``edge not an
    object`` or ``edge end not in nodes: <end>``.  Null answers have no object.  Ids are compared as
    texts, so that 1 and "1" are one id; an absent end is found if a node has no id.
    """
    names = [c for c in answers.columns if c not in ("nodes", "edges", "error")]
    given = answers.select(*names, outermost_object(F.col(raw)).alias("_text"))
    whole = F.from_json(F.concat(F.lit("["), F.col("_text"), F.lit("]")), "array<string>")
    given = given.withColumn("_whole", F.when(F.size(whole) == 1, F.get(whole, F.lit(0)))).withColumn("_map", F.from_json("_whole", "map<string,string>"))
    at = lambda name: F.try_element_at("_map", F.lit(name))
    given = given.withColumn("_nodes", _listed(at("nodes"))).withColumn("_edges", _listed(at("edges")))
    given = given.withColumn("_nodes", F.transform("_nodes", lambda t: _object(t, OLD_NODE))).withColumn("_edges", F.transform("_edges", lambda t: _object(t, OLD_EDGE)))
    objects = F.filter("_nodes", lambda n: n.isNotNull())
    given = given.withColumn("_ids", F.transform(objects, lambda n: n["id"]))
    known = lambda end: F.exists("_ids", lambda i: i.eqNullSafe(end))
    wrong = lambda e: F.when(e.isNull(), "edge not an object").when(~known(e["src"]), F.concat(F.lit("edge end not in nodes: "), F.coalesce(e["src"], F.lit("None")))).when(~known(e["dst"]), F.concat(F.lit("edge end not in nodes: "), F.coalesce(e["dst"], F.lit("None"))))
    first = F.get(F.filter(F.transform("_edges", wrong), lambda w: w.isNotNull()), F.lit(0))
    error = F.when(F.col("_text").isNull(), "no object").when(F.col("_map").isNull(), "invalid json").when(F.col("_nodes").isNull() | F.col("_edges").isNull(), "nodes or edges not arrays").otherwise(first)
    given = given.withColumn("error", error)
    return given.select(*names, "error", *[F.when(F.col("error").isNull(), F.col(f"_{c}")).alias(c) for c in ("nodes", "edges")])


def factor_of(nodes: Column, ident: Column, words: Column) -> Column:
    """The factor of the last event node of an id whose factor is one of ``words``; null if there is none."""
    fits = F.filter(nodes, lambda n: n.isNotNull() & (n["kind"] == "event") & n["id"].eqNullSafe(ident) & F.array_contains(words, n["event_type"]))
    return F.try_element_at(fits, F.lit(-1))["event_type"]


def typed_pairs(graphs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(record_id, src, dst): distinct pairs of different factors of a record that an edge of a leading type connects.

    ``vocabulary`` (factor_type) is a list of words that fits one row; edges or nodes that are
    no objects and ends that are no events of the vocabulary make no pair, nor do records that
    :func:`parsed` rejects, whose edges are null.
    """
    words = vocabulary.agg(F.array_distinct(F.collect_list("factor_type")).alias("_words"))
    rows = graphs.select("record_id", "nodes", "edges").crossJoin(F.broadcast(words))  # one row
    leads = F.filter("edges", lambda e: e.isNotNull() & e["type"].isin(*LEADING))
    ends = F.transform(leads, lambda e: F.struct(factor_of(F.col("nodes"), e["src"], F.col("_words")).alias("src"), factor_of(F.col("nodes"), e["dst"], F.col("_words")).alias("dst")))
    pairs = F.array_distinct(F.filter(ends, lambda p: p["src"] != p["dst"]))
    return rows.select("record_id", F.explode(pairs).alias("p")).select("record_id", "p.src", "p.dst")


def chain_pairs(chains: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(record_id, src, dst): the same of chains, whose ``nodes`` (idx, factor_type, caused_by of src) cite others; every strength counts."""
    words = vocabulary.agg(F.array_distinct(F.collect_list("factor_type")).alias("_words"))
    rows = chains.select("record_id", "nodes").crossJoin(F.broadcast(words))  # one row

    def factor(idx):
        return F.try_element_at(F.filter("nodes", lambda n: n.isNotNull() & n["idx"].eqNullSafe(idx) & F.array_contains(F.col("_words"), n["factor_type"])), F.lit(-1))["factor_type"]

    def ends(n):
        own = F.transform(n["caused_by"], lambda x: F.struct(factor(x["src"]).alias("src"), factor(n["idx"]).alias("dst")))
        return F.when(n["caused_by"].isNotNull(), own).otherwise(F.array().cast("array<struct<src:string,dst:string>>"))

    cited = F.flatten(F.transform(F.filter("nodes", lambda n: n.isNotNull()), ends))
    return rows.select("record_id", F.explode(F.array_distinct(F.filter(cited, lambda p: p["src"] != p["dst"]))).alias("p")).select("record_id", "p.src", "p.dst")


def precedence(pairs: DataFrame) -> DataFrame:
    """(category, src, dst, n): records by pair."""
    return pairs.groupBy("category", "src", "dst").agg(F.count("*").alias("n"))
