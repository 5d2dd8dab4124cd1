"""WARC archives with an external merge of capture indexes.

Writing: Spark's text writer puts one WARC/1.1 record after the other (the record's
closing blank lines are the line separator), gzipped, into the shared folder; any file
system that Spark knows will do, and its commit protocol copes with lost executors.
Payloads of at least ``LEAST_BYTES`` bytes that occur again are ``revisit`` records
that refer to the capture with the largest page_id.

Reading: every archive is parsed record by record.  Its captures, sorted by URL key,
timestamp and page_id, are one run.  Range cuts divide each run, and within a range a
loser tree merges the runs' segments, so that the ranges in order are the globally
ordered capture histories.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import by_group, shared_dir, stored

LEAST_BYTES = 1000
#: Records of an archive: as many as make about so many payload bytes.
ARCHIVE_BYTES = 16_000_000
_CRLF = "\r\n"
_HEX = re.compile(r"[0-9a-f]{40}")


def resolve_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages with payload_bytes, payload_digest (hex SHA-1) and refers_to (null: a response).

    Equal payloads have the same digest and length.  The largest page_id of each group
    is found by an aggregation; groups of one page never reach the join.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    p = pages.withColumn("payload_bytes", F.octet_length(body).cast("long")).withColumn("payload_digest", F.sha1(body))
    groups = p.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first_id"), F.count("*").alias("k"))
    groups = stored(groups.filter("k > 1").drop("k"), "copies")
    p = p.join(groups, ["payload_digest", "payload_bytes"], "left")
    return p.withColumn("refers_to", F.when(F.col("page_id") < F.col("first_id"), F.col("first_id"))).drop("first_id")


def _record_id(page_id: Column) -> Column:
    h = F.sha2(F.concat(F.lit("record-"), page_id.cast("string")), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _header(value: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")


def records(pages: DataFrame, date: Column) -> DataFrame:
    """(value, page_id): the text of one WARC record per row of :func:`resolve_revisits`."""
    revisit = F.col("refers_to").isNotNull()
    payload = F.when(revisit, "").otherwise(F.coalesce(F.col("html").cast("string"), F.lit("")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), _header(F.col("url"))),
        F.when(F.col("url").isNull(), F.lit("X-Target-URI-Null: 1")),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(F.encode(payload, "UTF-8")).cast("string"), F.lit(_CRLF)),
    ]
    return pages.select(F.concat_ws(_CRLF, *lines, payload).alias("value"), "page_id")


def write_archives(pages: DataFrame, path: str, date: Column, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a WARC record per row of ``pages`` (page_id, url, html) under ``path``.

    Null html is an empty payload; a null URL is noted and comes back null.  Rows are
    dealt to archives by a hash of page_id and URL, of which a hot host is no concern.
    """
    resolved = resolve_revisits(pages, least_bytes)
    total = pages.agg(F.sum(F.octet_length(F.col("html").cast("string"))).alias("b")).first().b or 0
    archives = max(8, -(-total // archive_bytes))
    dealt = records(resolved, date).repartition(archives, F.xxhash64("page_id", "value")).select("value")
    dealt.write.option("lineSep", _CRLF * 2).option("compression", "gzip").text(path)


def parse_archive(data: bytes):
    """(headers, payload) of each record of a WARC file's bytes."""
    at, n = 0, len(data)
    while at < n:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(headers["Content-Length"])
        payload = data[end + 4 : end + 4 + size]
        if len(payload) != size:
            raise ValueError("a WARC record is cut short")
        at = end + 4 + size + 4
        yield headers, payload


def url_key(url: str | None) -> str:
    """Host parts in reverse order, then the rest: captures of a site sort together."""
    m = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)(.*)", url or "", re.I | re.S)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + m[2] if m else (url or "")


CAPTURE = "url_key string, ts string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"
_FIELDS = [f.split()[0] for f in CAPTURE.split(", ")]


def _captures_of(archive: str, data: bytes):
    """Captures of one archive, checked against the digests of its payloads."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for h, payload in parse_archive(data):
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        if not _HEX.fullmatch(digest):
            digest = base64.b32decode(digest).hex()
        size = int(h.get("X-Payload-Length", len(payload)))
        if h["WARC-Type"] != "revisit" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError(f"payload of {h['WARC-Record-ID']} does not have its digest")
        url = None if "X-Target-URI-Null" in h else h.get("WARC-Target-URI", "")
        page, refers = h.get("X-Page-ID") or None, h.get("X-Refers-To-Page-ID") or None
        yield (url_key(url), h["WARC-Date"], int(page) if page else None, url, size, digest, h["WARC-Type"], int(refers) if refers else None, archive)


def _order(c) -> tuple:
    return (c[0], c[1], c[2] is not None, c[2] or 0)


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, the root's winner goes out."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = [r for r in runs if r], key
        self.k = len(self.runs)
        self.at = [0] * self.k
        self.heads = [key(r[0]) for r in self.runs]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._rise(leaf, build=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def _rise(self, leaf: int, build: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and build:
                self.losers[node] = winner
                return
            if other >= 0 and self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k:
            w = self.losers[0]
            if self.heads[w] is None:
                return
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = self.key(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            self._rise(w)


def read_captures(spark, path: str, ranges: int | None = None) -> DataFrame:
    """Captures of the archives under ``path`` with ``range_id`` and ``position`` in it.

    Ordered by (range_id, position) they are in the order of URL key, timestamp and
    page_id.  Payloads are checked against their digests.  An archive must fit a task
    (see ``ARCHIVE_BYTES``); a range holds about one archive's captures, and a URL with
    many captures is cut by timestamp and page like any other.
    """
    archives = spark.read.format("binaryFile").load(path).select("path", "content")

    def runs(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = sorted(_captures_of(name.rpartition("/")[2], data), key=_order)
                for lo in range(0, len(got), 2000):
                    cols = list(zip(*got[lo : lo + 2000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, _ARROW, strict=True)], _FIELDS)

    captures = stored(archives.mapInArrow(runs, CAPTURE), "runs")
    count = captures.count()
    k = ranges or max(1, min(4096, -(-count // 4000)))
    if k > 1:  # cuts from a seeded sample of captures: a few numbers for each range
        share = min(1.0, 64 * k / max(1, count))
        sample = captures.select("url_key", "ts", "page_id").filter(F.pmod(F.xxhash64("page_id", "url_key"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        keys = sorted((r.url_key, r.ts, r.page_id is not None, r.page_id or 0) for r in sample.collect())
        cuts = [keys[i * len(keys) // k] for i in range(1, k)] if keys else []
    else:
        cuts = []
    shared = spark.sparkContext.broadcast(cuts)

    def segments(batches):
        # rows of a run come in order; a task may see a run in parts, each of them a sorted segment
        for batch in batches:
            rows = sorted(zip(*[batch.column(i).to_pylist() for i in range(len(_FIELDS))], strict=True), key=lambda c: (c[8], _order(c)))
            out: dict[tuple[int, str], list] = {}
            for c in rows:
                out.setdefault((bisect.bisect_right(shared.value, _order(c)), c[8]), []).append(c)
            made = [(r, [dict(zip(_FIELDS, c, strict=True)) for c in seg]) for (r, _), seg in out.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.list_(pa.struct(list(zip(_FIELDS, _ARROW, strict=True)))))], ["range_id", "segment"])

    def merge(key, batches):
        held = [[tuple(c[f] for f in _FIELDS) for c in seg] for batch in batches for seg in batch.column(1).to_pylist()]
        merged = list(LoserTree(held, _order))
        cols = list(zip(*merged, strict=True)) if merged else [[] for _ in _FIELDS]
        r = key[0].as_py()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r] * len(merged), pa.int32()), pa.array(range(len(merged)), pa.int64()), *[pa.array(c, kind) for c, kind in zip(cols, _ARROW, strict=True)]], ["range_id", "position", *_FIELDS]
        )

    cut = captures.mapInArrow(segments, f"range_id int, segment array<struct<{CAPTURE.replace(' ', ':').replace(',:', ',')}>>")
    return cut.groupBy("range_id").applyInArrow(by_group(merge), f"range_id int, position long, {CAPTURE}")


_ARROW = [pa.int64() if f.split()[1] == "long" else pa.string() for f in CAPTURE.split(", ")]


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back in capture order.

    Pages have no capture time; the query takes 2024-01-01 plus page_id seconds.
    """
    import uuid

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    date = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.col("page_id"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    path = f"{shared_dir(spark)}/causaloom/{uuid.uuid4().hex}-warc"
    write_archives(pages, path, date)
    out = read_captures(spark, path)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id < g.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < g.first_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes = g.payload_bytes
"""
