"""Writers: lines of JSON, CSV by category, graph markup, summaries, resumable appends."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, compressed: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if compressed else "none").json(path)


def write_by_category(df: DataFrame, path: str, category: str = "category") -> None:
    """One folder of CSV per category; names keep letters, digits, dots and dashes."""
    safe = F.regexp_replace(category, r"[^A-Za-z0-9._-]", "_")
    df.withColumn("_part", safe).write.mode("overwrite").option("header", True).option("nullValue", "").partitionBy("_part").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def remaining(todo: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("source", "record_id")) -> DataFrame:
    """Work whose key is not done yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def graphml(nodes: DataFrame, edges: DataFrame, most: int = 100_000) -> str:
    """GraphML of a small graph (the vocabulary bounds it; more than ``most`` edges are refused)."""
    e = edges.orderBy("src", "dst").limit(most + 1).collect()
    if len(e) > most:
        raise ValueError("the graph is too large for one document")
    attributes = [c for c in edges.columns if c not in ("src", "dst")]
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="n_records" for="node" attr.name="count" attr.type="long"/>']
    out += [f'<key id={quoteattr(a)} for="edge" attr.name={quoteattr(a)} attr.type="double"/>' for a in attributes]
    out.append('<graph edgedefault="directed">')
    out += [f'<node id={quoteattr(r.factor_type)}><data key="n_records">{r.n_records}</data></node>' for r in nodes.orderBy("factor_type").limit(most).collect()]
    out += [f"<edge source={quoteattr(r.src)} target={quoteattr(r.dst)}>" + "".join(f"<data key={quoteattr(a)}>{r[a]}</data>" for a in attributes) + "</edge>" for r in e]
    return "\n".join([*out, "</graph>", "</graphml>"])


def markdown_summary(edges: DataFrame, outcomes: DataFrame) -> str:
    """Top 25 edges and top 20 factors as tables."""
    lines = ["| src | dst | support | p | lift |", "|---|---|---|---|---|"]
    lines += [f"| {r.src} | {r.dst} | {r.support} | {r.p_dst_given_src:.3f} | {r.lift:.2f} |" for r in edges.orderBy(F.desc("support"), "src", "dst").limit(25).collect()]
    lines += ["", "| factor | records | risk ratio |", "|---|---|---|"]
    lines += [f"| {r.factor_type} | {r.n_records} | {r.risk_ratio:.3f} |" for r in outcomes.orderBy(F.desc("n_records"), "factor_type").limit(20).collect()]
    return "\n".join(lines)


def json_summary(**frames: DataFrame) -> str:
    """Small frames as one nested document."""
    return json.dumps({k: [r.asDict(recursive=True) for r in f.collect()] for k, f in frames.items()}, sort_keys=True, default=str)
