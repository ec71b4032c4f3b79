"""Explicit schemas of the tables; nested values are real arrays and structs."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_ITEM = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("source_native_id", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("remote", T.BooleanType()),  # true / false / null = the feed does not say
    T.StructField("description", T.StringType()),
    T.StructField("salary_text", T.StringType()),
    T.StructField("posted_at", T.TimestampType()),
])

POSTING_CONTENT = (
    "company", "company_normalized", "title", "title_family", "seniority", "variant_markers",
    "location", "location_key", "remote", "salary_text", "description", "description_hash", "url",
    "canonical_url", "posted_at",
)
POSTING_KEY = ("source", "source_native_id")
POSTING_LIFECYCLE = ("first_seen_at", "last_seen_at", "missed_runs", "status")

DIMENSION = "struct<score:double,evidence:array<string>,note:string>"
DIMENSIONS = (
    "struct<" + ",".join(
        f"{name}:{DIMENSION}"
        for name in ("skillOverlap", "seniorityMatch", "agenticCentrality", "locationFit",
                     "compSignal", "companySignal")
    ) + ">"
)
SCORE_RESULT = (
    f"description_hash string, overall double, dimensions {DIMENSIONS}, uncertainty string, "
    "rationale string, error string"
)
THREAD_POSTING = (
    "struct<company:string,title:string,location:string,remote:boolean,salaryText:string,"
    "url:string,summary:string>"
)
SOURCE_STATS = (
    "struct<source:string,fetched:bigint,created:bigint,updated:bigint,expired:bigint,"
    "errors:bigint>"
)
