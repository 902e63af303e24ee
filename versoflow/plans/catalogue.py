"""All queries of the core library and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from versoflow.plans import parts, replies, segmenting, workflow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**segmenting.QUERIES, **workflow.QUERIES, **replies.QUERIES, **parts.QUERIES}
SQL: dict[str, str] = {**segmenting.SQL, **workflow.SQL, **replies.SQL, **parts.SQL}
