"""Containers with translations put in place of their blocks: from EPUB files to EPUB files as one DataFrame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoflow.functions import html
from versoflow.functions.text import normalize
from versoflow.operators import matching
from versoflow.session import materialize
from versoflow.sources import epub


def refilled_epubs(epubs: DataFrame, mapping: DataFrame, fuzzy: bool = True, keep_original: bool = False) -> DataFrame:
    """doc_id, content, replaced: each container with the blocks of its documents translated, and how many were.

    ``mapping`` is as ``matching.translation_map`` gives it. Blocks are matched by their distinct texts, exactly or, with
    ``fuzzy``, by the most similar entry; documents without a match stay byte for byte. Containers that can't be read come
    out as they are. Documents are gathered by container, which is one row already.
    """
    pages = materialize(epub.documents(epubs).withColumn("page_id", F.xxhash64("doc_id", "name")))
    blocks = materialize(html.explode_blocks(pages.dropDuplicates(["page_id"]), "page_id").select("page_id", "text"))
    texts = blocks.select("text").distinct().withColumn("text_id", F.xxhash64("text"))
    if fuzzy:
        known = matching.match(texts, mapping, "text_id").select("text_id", "translation")
    else:
        known = matching.exact_match(texts, mapping).select("text_id", "translation")
    found = known.where("translation is not null").join(texts, "text_id").select("text", "translation")
    entries = blocks.distinct().join(found, "text").select("page_id", "text", "translation")
    done = html.refill(pages.dropDuplicates(["page_id"]), entries, "page_id", keep_original=keep_original).where("replaced > 0")
    changed = pages.select("doc_id", "name", "page_id").join(done, "page_id").groupBy("doc_id").agg(F.collect_list(F.struct("name", "html")).alias("__pages"), F.sum("replaced").cast("int").alias("replaced"))

    @F.pandas_udf("binary")
    def rewritten(content: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([c if p is None or not len(p) else epub.rewrite_epub(bytes(c), {x["name"]: x["html"] for x in p}) for c, p in zip(content, parts)])

    joined = epubs.select("doc_id", "content").join(changed, "doc_id", "left")
    none = F.array().cast("array<struct<name:string,html:string>>")
    return joined.select("doc_id", rewritten("content", F.coalesce("__pages", none)).alias("content"), F.coalesce("replaced", F.lit(0)).alias("replaced"))


def mapping_of(pairs: DataFrame) -> DataFrame:
    """A mapping of plain pairs (original, translation), the least translation of each normalised original."""
    keyed = pairs.select(normalize("original").alias("key"), "translation").where("key <> ''").groupBy("key").agg(F.min("translation").alias("translation"))
    zero = F.lit(0).cast("bigint")
    return keyed.withColumn("at", F.struct(zero.alias("doc_id"), zero.alias("segment_id"), zero.alias("row_id"), F.lit(0).alias("rank")))
