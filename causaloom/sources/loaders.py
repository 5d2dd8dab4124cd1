"""Readers of incident sources into the eight-column corpus row.

Every reader returns strings with '' for missing values; schemas are explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CORPUS = ["record_id", "source", "date", "location", "title", "text", "url", "tail"]


def _s(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def corpus_row(df: DataFrame) -> DataFrame:
    """Common columns in order, as strings, missing ones ''."""
    return df.select(*[(_s(c) if c in df.columns else F.lit("")).alias(c) for c in CORPUS])


def union_sources(*frames: DataFrame) -> DataFrame:
    out = corpus_row(frames[0])
    for f in frames[1:]:
        out = out.unionByName(corpus_row(f))
    return out


def all_string_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, **options) -> DataFrame:
    """CSV or TSV as strings; rows that do not parse are dropped; a byte order mark is no part of the first name."""
    df = spark.read.options(sep=sep, header=header, mode="DROPMALFORMED", multiLine=True, escape='"', inferSchema=False, **options).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def bea(spark: SparkSession, path: str) -> DataFrame:
    d = all_string_csv(spark, path)
    location = F.concat(_s("location"), F.lit(", "), _s("state_of_occurrence"))
    return corpus_row(d.select(_s("file_number").alias("record_id"), F.lit("BEA").alias("source"), _s("date").alias("date"), location.alias("location"), _s("title").alias("title"), _s("summary").alias("text"), _s("detail_url").alias("url"), _s("registration").alias("tail")))


def modern_narratives(narratives: DataFrame, events: DataFrame, source: str = "NTSB_AVALL") -> DataFrame:
    """Narratives of one aircraft each: factual parts and cause joined, the incident narrative where they are empty."""
    body = F.trim(F.concat_ws("  ", _s("narr_accp"), _s("narr_accf"), _s("narr_cause")))
    n = narratives.select("ev_id", F.concat_ws("_", F.col("ev_id"), F.col("Aircraft_Key").cast("string")).alias("record_id"), F.when(F.length(body) == 0, F.trim(_s("narr_inc"))).otherwise(body).alias("text"))
    e = events.select("ev_id", F.substring(_s("ev_date"), 1, 8).alias("date")).dropDuplicates(["ev_id"])
    return corpus_row(n.join(e, "ev_id", "left").withColumn("source", F.lit(source)))


def pre_1982(second: DataFrame, first: DataFrame) -> DataFrame:
    """Second halves with the first half of the same record number, if there is one."""
    j = second.join(first, "RecNum", "left")
    return corpus_row(j.select(_s("DOCKET_NO").alias("record_id"), F.lit("NTSB_PRE1982").alias("source"), _s("DATE_OCCURRENCE").alias("date"), F.concat_ws(", ", "LOCATION", "LOCAT_STATE_TERR").alias("location"), F.trim(F.concat(_s("REMARKS"), F.lit(" "), _s("CAUSE"))).alias("text"), _s("REGIST_NO").alias("tail")))


def report_manifest(spark: SparkSession, manifest: str, text_dir: str) -> DataFrame:
    """Manifest rows with the text of their file; missing files give ''."""
    m = all_string_csv(spark, manifest).withColumn("file", F.regexp_extract(F.col("txt_path"), r"([^/\\]+)$", 1))
    texts = spark.read.text(text_dir, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.col("value").alias("text"))
    j = m.join(texts, "file", "left")
    return corpus_row(j.select(_s("report_number").alias("record_id"), F.lit("NTSB_REPORT").alias("source"), _s("accident_date").alias("date"), _s("location").alias("location"), _s("title").alias("title"), _s("text").alias("text"), _s("pdf_url").alias("url")))


def aids(spark: SparkSession, a_path: str, e_path: str) -> DataFrame:
    """Metadata joined with the longest narrative of each id; no narrative: the remark."""
    a = all_string_csv(spark, a_path, sep="\t", nullValue="\\N").withColumn("bucket", F.regexp_extract(F.input_file_name(), r"a(\d{4}_\d{2})\.txt$", 1))
    e = all_string_csv(spark, e_path, sep="\t", nullValue="\\N")
    names = {c.lower(): c for c in e.columns}
    e = e.select(F.col(names.get("c5") or names["id"]).alias("c5"), _s(names.get("remark") or names["rmks"]).alias("narrative"))
    longest = Window.partitionBy("c5").orderBy(F.size(F.split("narrative", r"\s+")).desc(), "narrative")
    e = e.withColumn("_rn", F.row_number().over(longest)).filter("_rn = 1").drop("_rn")
    j = a.join(e, "c5", "left")
    text = F.when(F.length(F.coalesce("narrative", F.lit(""))) > 0, F.col("narrative")).otherwise(_s("c119"))
    return corpus_row(j.select(_s("c5").alias("record_id"), F.concat(F.lit("FAA_AIDS:"), F.col("bucket")).alias("source"), _s("c9").alias("date"), F.concat_ws(", ", "c14", "c13").alias("location"), text.alias("text"), _s("c22").alias("tail")))


def coded_projection(df: DataFrame, names: dict[str, str], source: str) -> DataFrame:
    """Coded columns under readable names, trimmed, blanks null."""
    return df.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(n) for c, n in names.items() if c in df.columns], F.lit(source).alias("source"))


def tsb(spark: SparkSession, path: str) -> DataFrame:
    d = all_string_csv(spark, path)
    d = d.withColumnRenamed(d.columns[0], "OccID")
    return corpus_row(d.select(_s("OccNo").alias("record_id"), F.lit("TSB_CANADA").alias("source"), F.substring(_s("OccDate"), 1, 10).alias("date"), _s("Location").alias("location"), _s("CommonName").alias("title"), _s("Summary").alias("text")))


def jsonl(spark: SparkSession, path: str, schema: str, keep_bad: bool = False) -> DataFrame:
    """JSON lines, gzipped or not; bad lines are dropped, or kept in ``_bad``."""
    if keep_bad:
        return spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def routine_hours(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated hours: month, day, hour, temperature and dew point in Celsius; -9999 is missing."""
    f = F.split(F.trim("value"), r"\s+")
    d = spark.read.text(path).select(*[f[i].cast("int").alias(n) for i, n in enumerate(("year", "month", "day", "hour", "t", "td"))])
    return d.filter("t <> -9999 and td <> -9999").select("year", "month", "day", "hour", (F.col("t") / 10).alias("t_c"), F.least(F.col("t") / 10, F.col("td") / 10).alias("td_c"))


def by_tables(tables: dict[str, DataFrame]) -> DataFrame | None:
    """The loader that fits a database's tables; None for an unknown layout."""
    low = {k.lower(): v for k, v in tables.items()}
    if "narratives" in low and "events" in low:
        return modern_narratives(low["narratives"], low["events"])
    if "secondhalf" in low and "firsthalf" in low:
        return pre_1982(low["secondhalf"], low["firsthalf"])
    return None
