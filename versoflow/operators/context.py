"""Context for a segment's translation from the segments before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versoflow.functions.text import is_translated, strip
from versoflow.operators.ordered import preceding, row_numbers


def _tail_of(text: Column, first: int, most: int) -> Column:
    return strip(F.right(F.right(strip(F.coalesce(text, F.lit(""))), F.lit(max(0, first))), F.lit(max(0, most))))


def previous_context(segments: DataFrame, max_chunk: int = 2000, max_length: int = 2000, tie: list[str] = ["row_id"]) -> DataFrame:  # noqa: B006
    """``context``: the end of the original text of the segment before, a quarter of a chunk at most; empty for the first.

    The original, not the translation, is used, so that all batches may run at once.
    """
    before = preceding(segments, "doc_id", "segment_id", F.col("original_text"), 1, "__before", tie)
    return before.withColumn("context", _tail_of(F.get("__before", F.lit(0)), int(max_chunk * 0.25), max_length)).drop("__before")


def translated_window(segments: DataFrame, size: int = 3, tie: list[str] = ["row_id"]) -> DataFrame:  # noqa: B006
    """``window``: translations of up to ``size`` segments before, those that are translated, joined by spaces."""
    text = F.when(is_translated("translated_text"), strip("translated_text"))
    before = preceding(segments, "doc_id", "segment_id", text, size, "__before", tie)
    kept = F.filter("__before", lambda t: t.isNotNull())
    return before.withColumn("window", strip(F.array_join(kept, " "))).drop("__before")


#: Consecutive rows that are looked back over together.
STRETCH = 64


def vision_context(segments: DataFrame, most: int = 500, tie: list[str] = ["row_id"]) -> DataFrame:  # noqa: B006
    """``running``: the last ``most`` characters of all translations before, joined by line ends, as a running context of
    image calls has them. Null translations are empty lines.

    Rows are taken in stretches of consecutive ones, whose ends are joined first. A stretch has at least STRETCH
    characters, line ends included, so only so many before it matter, however short the texts; no window runs over a
    whole document.
    """
    held = row_numbers(segments, "doc_id", "segment_id", "__n", tie).withColumn("__t", F.right(F.coalesce(F.col("translated_text"), F.lit("")), F.lit(most)))
    held = held.withColumn("__s", F.floor((F.col("__n") - 1) / STRETCH))
    ends = held.groupBy("doc_id", "__s").agg(F.array_sort(F.collect_list(F.struct("__n", "__t"))).alias("__rows"))
    ends = ends.select("doc_id", "__s", F.right(F.array_join(F.col("__rows.__t"), "\n"), F.lit(most)).alias("__end"))
    reach = -(-most // STRETCH)
    carried = ends.select("doc_id", "__s", "__end", F.explode(F.sequence(F.col("__s") + 1, F.col("__s") + reach)).alias("__to"))
    carried = carried.groupBy(F.col("doc_id").alias("__d"), "__to").agg(F.array_sort(F.collect_list(F.struct("__s", "__end"))).alias("__ends"))
    inside = F.collect_list("__t").over(Window.partitionBy("doc_id", "__s").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1))
    joined = held.withColumn("__in", inside)
    joined = joined.join(carried, joined["doc_id"].eqNullSafe(carried["__d"]) & (joined["__s"] == carried["__to"]), "left")
    lines = F.concat(F.coalesce(F.col("__ends.__end"), F.array().cast("array<string>")), F.col("__in"))
    return joined.withColumn("running", F.right(F.array_join(lines, "\n"), F.lit(most))).drop("__n", "__t", "__s", "__in", "__d", "__to", "__ends")
