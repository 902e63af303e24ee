"""Glossaries: merging the batches, when to stop, and the texts that go into prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versoflow.functions.text import is_blank, is_translated, strip

_KEY = ["source_lang", "target_lang"]


def merged(batches: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """term -> translation: the last batch that has a term counts; terms keep the place of their first.

    Terms and translations are stripped; blank ones are left out. ``keys`` keeps glossaries apart.
    """
    rows = batches.select(*keys, "batch_id", "ord", strip("term").alias("term"), strip("translation").alias("translation")).where(~is_blank("term") & ~is_blank("translation"))
    at = F.struct("batch_id", "ord", "translation")
    return rows.groupBy(*keys, "term").agg(F.max_by("translation", at).alias("translation"), F.min(F.struct("batch_id", "ord")).alias("first"), F.count("*").alias("n_given")).select(
        *keys, "term", "translation", F.col("first.batch_id").alias("first_batch"), F.col("first.ord").alias("first_ord"), "n_given"
    )


def saturation(batches: DataFrame, min_terms: int = 50, max_terms: int = 200, threshold: float = 0.3) -> DataFrame:
    """For each batch: new terms, terms so far, and whether glossary building stops with it.

    It stops at ``max_terms``; or when, with ``min_terms`` reached and three batches seen, the mean of the last three
    batches' new terms lies below ``threshold`` times the mean of all for the second time running. Batches below
    ``min_terms`` leave the count of low batches as it is. Batches behind the stop have ``used`` false.

    One row a batch after the aggregate: windows over all batches are over few rows.
    """
    rows = batches.select("batch_id", strip("term").alias("term")).where(~is_blank("term"))
    first = rows.groupBy("term").agg(F.min("batch_id").alias("batch_id")).groupBy("batch_id").agg(F.count("*").alias("fresh"))
    per = batches.select("batch_id").where("batch_id is not null").distinct().join(first, "batch_id", "left").select("batch_id", F.coalesce("fresh", F.lit(0)).alias("new_terms"))
    whole = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    three = Window.orderBy("batch_id").rowsBetween(-2, 0)
    seen = per.withColumn("total_terms", F.sum("new_terms").over(whole)).withColumn("n", F.count("*").over(whole))
    seen = seen.withColumn("mean_all", F.avg("new_terms").over(whole)).withColumn("mean_last", F.avg("new_terms").over(three))
    tested = (F.col("total_terms") >= min_terms) & (F.col("n") >= 3)
    low = F.col("mean_last") < F.col("mean_all") * threshold
    seen = seen.withColumn("state", F.when(~tested, F.lit(None)).otherwise(low.cast("int")))
    earlier = F.last("state", ignorenulls=True).over(Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumn("stops", (F.col("total_terms") >= max_terms) | (F.coalesce(F.col("state"), F.lit(0)).cast("boolean") & (F.coalesce(earlier, F.lit(0)) == 1)))
    stopped = F.coalesce(F.max(F.col("stops").cast("int")).over(Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return seen.withColumn("used", stopped == 0).select("batch_id", "new_terms", "total_terms", "mean_all", "mean_last", "stops", "used")


def extraction_text(segments: DataFrame, most: int = 8000, tie: list[str] = ["row_id"]) -> DataFrame:  # noqa: B006
    """For each document the text that terms are taken from: pairs of translated segments, ``most`` characters of it.

    Only the rows that begin within the limit are gathered, so no document's whole text meets in one row.
    """
    from versoflow.operators.ordered import running_sum

    pair = F.concat(F.lit("Original: "), strip("original_text"), F.lit("\nTranslation: "), strip("translated_text"))
    rows = segments.where(is_translated("translated_text") & ~is_blank("original_text")).select("doc_id", "segment_id", *tie, pair.alias("pair"))
    upto = running_sum(rows, "doc_id", "segment_id", F.char_length("pair") + 2, "__sum", tie)
    kept = upto.where(F.col("__sum") - F.char_length("pair") - 2 < most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", *tie, "pair"))), lambda r: r["pair"]), "\n\n")
    return kept.groupBy("doc_id").agg(F.left(text, F.lit(most)).alias("extraction_text"))


def as_list(glossary: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The glossary as a bullet list for a prompt, in order of first appearance."""
    line = F.format_string("- **%s**: %s", "term", "translation")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_batch", "first_ord", "term", line.alias("line")))), lambda r: r["line"]), "\n")
    return (glossary.groupBy(*keys) if keys else glossary.groupBy()).agg(body.alias("glossary_text"), F.count("*").alias("n_terms"))


def first_terms(glossary: DataFrame, n: int = 10) -> DataFrame:
    """The first n terms by appearance."""
    return glossary.orderBy("first_batch", "first_ord", "term").limit(n)
