"""Text operators that no built-in covers: compatibility normalisation, report splitting, label scraping."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else "")


def clean_text(text: Column) -> Column:
    """NFKC, control characters and line breaks to spaces, soft hyphens out, line-end hyphens joined, page furniture out."""
    t = nfkc(text)
    for pattern, by in ((r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), ("­", ""), (r"-\n(?=(?U)\w)", ""), (r"[\r\n\t]", " "), (vocab.HEADER_FRAGMENTS, " "), (vocab.PAGE_ARTIFACTS, " "), (r"(?U)\s+", " ")):
        t = F.regexp_replace(t, pattern, by)
    return F.trim(t)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


HEADING = re.compile(r"(?im)^\s*(?:\d+(?:\.\d+)*\.?\s+)?(findings|conclusions|probable cause|recommendations|analysis)\s*:?\s*$")
ITEM = re.compile(r"(?m)^\s*(\d{1,2})[.)]\s+")


def split_report(docs: DataFrame, least_place: float = 0.2, reach: int = 4000, shortest: int = 20, longest: int = 2000) -> DataFrame:
    """(doc_id, section, item, text): sections after a heading past the first part of a report, the last heading of a
    kind winning, and their numbered items of usable length."""

    def cut(batches):
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf.doc_id, pdf.text, strict=True):
                text = text or ""
                found = {m[1].lower(): m for m in HEADING.finditer(text) if m.start() >= least_place * len(text)}
                for name, m in found.items():
                    after = [o.start() for o in found.values() if o.start() > m.start()]
                    body = text[m.end() : min([m.end() + reach, *after])]
                    parts = ITEM.split(body)
                    items = parts[2::2] if len(parts) > 2 else [body]
                    for k, item in enumerate(items):
                        item = " ".join(item.split())
                        if shortest <= len(item) <= longest:
                            rows.append((doc_id, name, k, item))
            yield pd.DataFrame(rows, columns=["doc_id", "section", "item", "text"])

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, section string, item int, text string")


TAG = re.compile(r"<[^>]+>")


def label_fields(pages: DataFrame, labels: list[str]) -> DataFrame:
    """(page_id, label, value): text lines of a page, where a label line is followed by its value."""

    def scrape(batches):
        wanted = {x.lower(): x for x in labels}
        for pdf in batches:
            rows = []
            for page_id, body in zip(pdf.page_id, pdf.html, strict=True):
                lines = [" ".join(html.unescape(x).split()) for x in TAG.sub("\n", body or "").split("\n")]
                lines = [x for x in lines if x]
                for a, b in zip(lines, lines[1:], strict=False):
                    if a.rstrip(":").lower() in wanted:
                        rows.append((page_id, wanted[a.rstrip(":").lower()], b))
            yield pd.DataFrame(rows, columns=["page_id", "label", "value"])

    return pages.select("page_id", "html").mapInPandas(scrape, "page_id long, label string, value string")


def links_of(pages: DataFrame) -> DataFrame:
    """(page_id, href, text) of a page's links, by built-in functions."""
    link = F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s+[^>]*href="[^"]*"[^>]*>[^<]*</a>'), F.lit(0)))
    return pages.select("page_id", link.alias("a")).select("page_id", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", r">([^<]*)<", 1).alias("text"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, per_stratum: int, seed: int = 7) -> DataFrame:
    """The ``per_stratum`` rows of smallest seeded hash in each stratum."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_stratum).drop("_rn")


def two_pool_sample(rows: DataFrame, first: Column, key: str, n: int, share: float = 0.8, seed: int = 7) -> DataFrame:
    """``n`` rows, ``share`` of them from the first pool, the rest from the other, topped up from either."""
    order = F.xxhash64(F.lit(seed), key)
    pool = rows.withColumn("_first", first)
    a = pool.filter("_first").orderBy(order, key).limit(int(share * n)).drop("_first")
    b = pool.filter("not _first").orderBy(order, key).limit(n - int(share * n)).drop("_first")
    picked = a.unionByName(b)
    rest = rows.join(picked.select(key), key, "left_anti").orderBy(order, key).limit(n).select(*rows.columns)
    return picked.withColumn("_o", F.lit(0)).unionByName(rest.withColumn("_o", F.lit(1))).orderBy("_o", order, key).limit(n).drop("_o")
