"""Line dedup by site-relative frequency.

For every host the share of its pages that hold a line is the line's ratio; lines
above the boilerplate ratio are dropped from all pages of the host.  Pages of the same
text count once, so that a copied page is no boilerplate.  Counting is a two-stage
aggregation on (host, line hash), so a host with a third of all pages or a line that
every page holds costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, stored

#: A line on more than this share of a host's pages is boilerplate ...
RATIO = 0.01
#: ... and a line of at least so many words on more than that share.
LONG_WORDS, LONG_RATIO = 50, 0.002
#: Pages without the line that every host is taken to have besides its own: on a small host a few pages are no evidence.
PRIOR_PAGES = 400
#: At most so many boilerplate lines are broadcast (8 bytes each and their host); more are joined by document.
BROADCAST_LINES = 20_000


def _key(line):
    """Hash of a line without outer white space; null for blank lines."""
    bare = F.trim(F.regexp_replace(line, r"[\t\r\f\x0B]", " "))
    return F.when(F.length(bare) > 0, F.xxhash64(bare))


def _keys(text):
    return F.transform(F.split(text, "\n"), _key)


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, long_ratio: float = LONG_RATIO, prior: int = PRIOR_PAGES) -> DataFrame:
    """(host, line_key, pages, host_pages, ratio) of the lines above the ratio.

    A host's list holds at most (lines of a page on average) / ratio lines.
    """
    rows = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).cast("string").alias("text")).filter("text is not null").withColumn("page", F.xxhash64("text"))
    totals = rows.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_pages"))
    words = F.transform(F.split("text", "\n"), lambda x: F.struct(_key(x).alias("line_key"), (F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")) >= LONG_WORDS).alias("long")))
    lines = rows.select("host", "page", F.explode(F.array_distinct(F.filter(words, lambda x: x["line_key"].isNotNull()))).alias("x")).select("host", "page", "x.*")
    counts = lines.groupBy("host", "line_key", "page").agg(F.max("long").alias("long")).groupBy("host", "line_key").agg(F.count("*").alias("pages"), F.max("long").alias("long")).filter("pages > 1")
    found = counts.join(totals, "host").withColumn("ratio", F.col("pages") / (F.col("host_pages") + prior))
    return found.filter(F.col("ratio") > F.when(F.col("long"), F.lit(long_ratio)).otherwise(F.lit(ratio))).drop("long")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, long_ratio: float = LONG_RATIO, prior: int = PRIOR_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text`` and their number in ``lines_dropped``.

    No row is lost: a page of boilerplate only keeps an empty text.  Blank lines stay.
    Null texts stay null with 0 lines dropped; a null host is a host of its own (that
    of the empty name).  Lines compare without outer white space; a line repeated in
    one page, or in rows of the same text and host, counts once for its ratio and is
    dropped each time.  A ratio equal to the limit drops nothing.  Very long texts are
    taken whole, an empty table gives no rows.  An input column named ``lines_dropped``
    is replaced; other names do not matter.
    """
    docs = docs.drop("lines_dropped")
    names = docs.columns
    lines = stored(boilerplate_lines(docs, host, text, ratio, long_ratio, prior).select("host", "line_key"), "lines")
    few = lines.limit(BROADCAST_LINES + 1).collect()
    its_host, its_text, its_bad, left = (fresh(docs, c) for c in ("host", "page", "bad", "kept"))
    row = docs.withColumn(its_host, F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")))
    if len(few) <= BROADCAST_LINES:
        by_host: dict[str, list[int]] = {}
        for r in few:
            by_host.setdefault(r.host, []).append(r.line_key)
        bad = docs.sparkSession.createDataFrame(sorted((h, sorted(k)) for h, k in by_host.items()), f"`{its_host}` string, `{its_bad}` array<bigint>")
        joined = row.join(F.broadcast(bad), its_host, "left")
    else:
        # by document: first which lines go from which text, then the texts
        keyed = docs.select(F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("page"), F.explode(F.array_distinct(F.array_compact(_keys(F.col(f"`{text}`"))))).alias("line_key"))
        bad = keyed.distinct().join(lines, ["host", "line_key"], "left_semi").groupBy("host", "page").agg(F.collect_set("line_key").alias(its_bad))
        bad = bad.withColumnsRenamed({"host": its_host, "page": its_text})
        joined = row.withColumn(its_text, F.xxhash64(F.col(f"`{text}`").cast("string"))).join(bad, [its_host, its_text], "left")
    parts = F.split(F.col(f"`{text}`"), "\n")
    kept = F.filter(parts, lambda x: F.coalesce(~F.array_contains(F.col(its_bad), _key(x)), F.lit(True)))
    out = joined.withColumn(left, F.when(F.col(its_bad).isNotNull(), kept))
    dropped = F.coalesce(F.when(F.col(left).isNotNull(), F.size(parts) - F.size(left)), F.lit(0)).cast("long").alias("lines_dropped")
    new = F.when(F.col(left).isNotNull(), F.array_join(left, "\n")).otherwise(F.col(f"`{text}`"))
    return out.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in names], dropped)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents without the lines that fill more than a hundredth of their source's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_boilerplate(docs).select("doc_id", "source", "text", "lines_dropped")


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS host, text, pos, line,
         trim(regexp_replace(line, '[\\t\\r\\f\\x0B]', ' ', 'g'), ' ') AS bare
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) t
), totals AS (SELECT coalesce(source, '') AS host, count(DISTINCT text) AS host_pages FROM documents GROUP BY 1),
bad AS (
  SELECT host, bare
  FROM (SELECT host, bare, len(regexp_extract_all(bare, '[^\\x20\\x09-\\x0D]+')) >= 50 AS long, count(DISTINCT text) AS pages
        FROM lines WHERE bare <> '' GROUP BY 1, 2) c
  JOIN totals USING (host)
  WHERE pages > 1 AND pages / (host_pages + 400) > CASE WHEN long THEN 0.002 ELSE 0.01 END
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (b.bare IS NULL) AS text,
         count(b.bare) AS lines_dropped
  FROM lines l LEFT JOIN bad b ON l.host = b.host AND l.bare = b.bare GROUP BY 1
)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.lines_dropped, 0) AS lines_dropped
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
