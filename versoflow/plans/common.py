"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: White space as a class of an RE2 expression, and stripping by it.
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def blank_sql(x: str) -> str:
    return f"(NOT coalesce(regexp_matches({x}, '{NOT_WS}'), false))"


def translated_sql(x: str) -> str:
    return f"(NOT {blank_sql(x)} AND NOT contains(coalesce({x}, ''), '[Translation Failed'))"


def success_sql(x: str) -> str:
    return f"(coalesce({x}, '') <> '' AND NOT starts_with({x}, '[Failed') AND NOT ends_with({x}, 'Failed]'))"


#: One row a (doc_id, segment_id): the row loaded last.
LATEST = """latest AS (
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, segment_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS rn FROM segments
    ) WHERE rn = 1
)"""
