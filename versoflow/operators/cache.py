"""Cached contexts with a lifetime: keys, registration, look-up, expiry, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: files that were uploaded have no lifetime.
LASTING = "uploaded_files"


def cache_key(kind: str, day: Column, document: Column | None, content_hash: Column) -> Column:
    """``kind_YYYYMMDD[_document]_hash``, document and hash by their first eight characters."""
    parts = [F.lit(kind), F.date_format(day, "yyyyMMdd"), *([F.left(document, F.lit(8))] if document is not None else []), F.left(content_hash, F.lit(8))]
    return F.concat_ws("_", *parts)


def expiry(created: Column, ttl_hours: Column) -> Column:
    return created + ttl_hours * 3600


def is_expired(now: float) -> Column:
    """Whether an entry is past its lifetime at ``now``; entries without one and uploaded files never are."""
    return F.coalesce((F.col("type") != LASTING) & (F.col("expiry_time") <= now), F.lit(False))


def live(entries: DataFrame, now: float) -> DataFrame:
    return entries.where(~is_expired(now))


def listing(entries: DataFrame, now: float) -> DataFrame:
    """Live entries with ``is_expired``."""
    return live(entries.withColumn("is_expired", is_expired(now)), now)


def lookup(wanted: DataFrame, entries: DataFrame, now: float) -> DataFrame:
    """Wanted (content_hash) with the cache name of the first live entry of that hash, by creation, then by key."""
    first = live(entries, now).groupBy("content_hash").agg(F.min_by("cache_name", F.struct("created_at", "key")).alias("cache_name"))
    return wanted.join(first, "content_hash", "left")


def to_create(wanted: DataFrame, entries: DataFrame, now: float) -> DataFrame:
    """Each wanted hash that has no live entry, once: what to create before work fans out."""
    return wanted.select("content_hash").where("content_hash is not null").distinct().join(live(entries, now), "content_hash", "left_anti")


def statistics(entries: DataFrame, now: float) -> DataFrame:
    """Total, active and expired entries by type, and of all (type null)."""
    expired = is_expired(now)
    return entries.rollup("type").agg(F.count("*").alias("total"), F.count_if(~expired).alias("active"), F.count_if(expired).alias("expired")).where("total > 0")


def register(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after registration: of a (type, key) the entry created last counts."""
    both = entries.unionByName(new)
    names = both.columns
    best = F.max_by(F.struct(*names), F.struct("created_at", "cache_name")).alias("e")
    return both.groupBy("type", "key").agg(best).select(*[F.col(f"e.{n}").alias(n) for n in names])


def glossary_hash(glossary: DataFrame) -> DataFrame:
    """One row: a hash of a glossary that doesn't depend on the order of its entries.

    Every entry is hashed where it is; the small hashes alone are brought together in order.
    """
    each = glossary.select(F.md5(F.to_json(F.struct("term", "translation"))).alias("h"))
    return each.agg(F.md5(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("content_hash"), F.count("*").alias("n_terms"))
