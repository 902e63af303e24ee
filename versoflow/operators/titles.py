"""Chapter titles: which to translate, and writing the translations back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoflow.functions.text import has_chinese, is_blank, strip


def candidates(segments: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Distinct titles of new chapters that aren't blank or Chinese, with their first place in each document.

    ``documents`` (doc_id, title): the documents' own titles, which stand before all chapters (place -1).
    """
    rows = segments.where(F.coalesce("is_new_chapter", F.lit(False))).select("doc_id", F.col("chapter_title").alias("title"), "segment_id", F.lit(1).alias("__n"))
    if documents is not None:
        rows = rows.unionByName(documents.select("doc_id", "title", F.lit(-1).cast("bigint").alias("segment_id"), F.lit(0).alias("__n")))
    rows = rows.where(~is_blank("title") & ~has_chinese("title"))
    return rows.groupBy("doc_id", "title").agg(F.min("segment_id").alias("first_segment"), F.sum("__n").alias("n_chapters"))


def backfill(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Segments with translated chapter titles (title, translated_title) where there is a non-empty one.

    Of a title translated more than once the least translation counts.
    """
    known = translations.where(~is_blank("translated_title")).groupBy("title").agg(F.min(strip("translated_title")).alias("translated_title"))
    joined = segments.join(known, segments.chapter_title == known.title, "left").drop("title")
    return joined.withColumn("chapter_title", F.coalesce("translated_title", "chapter_title")).drop("translated_title")
