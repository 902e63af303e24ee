"""Tables of contents in CSV files: English or Chinese headers in any case, a byte-order mark, pages from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoflow.operators.toc import csv_items

# The headers of a column.
HEADERS = {"page": ("page", "页码"), "title": ("title", "标题"), "level": ("level", "层级")}


def read_toc_csv(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """doc_id, ord, level, title, key of one CSV file; empty if the file can't be read as contents."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    named = {c.replace("﻿", "").strip().lower(): c for c in raw.columns}
    picked = {k: next((named[h] for h in hs if h in named), None) for k, hs in HEADERS.items()}
    cols = [F.col(f"`{c}`").cast("string").alias(k) if (c := picked[k]) else F.lit(None).cast("string").alias(k) for k in ("page", "title", "level")]
    # one small file: its order is that of reading
    rows = raw.select(*cols).coalesce(1).withColumn("ord", F.monotonically_increasing_id().cast("int")).withColumn("doc_id", F.lit(doc_id).cast("bigint"))
    return csv_items(rows)
