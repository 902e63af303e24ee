"""Which segments are done, pending, failed or blocked, and resuming from that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoflow.functions.text import abridged, is_blocked, is_success, is_translated
from versoflow.operators.ordered import row_numbers


def latest_segments(segments: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each (doc_id, segment_id): the row loaded last, of equals the one of greatest row_id.

    An aggregate with map-side combine, so that repeated keys never meet in one sort. ``columns`` are those wanted besides
    the key, so that texts which nobody asks for are neither read nor shuffled.
    """
    names = segments.columns if columns is None else ["doc_id", "segment_id", *[c for c in columns if c not in ("doc_id", "segment_id")]]
    best = F.max_by(F.struct(*names), F.struct(F.col("loaded_at"), F.col("row_id"))).alias("s")
    return segments.groupBy("doc_id", "segment_id").agg(best).select(*[F.col(f"s.{n}").alias(n) for n in names])


def latest_ids(segments: DataFrame) -> DataFrame:
    """doc_id, segment_id, row_id of the rows that ``latest_segments`` keeps."""
    best = F.max(F.struct("loaded_at", "row_id")).alias("s")
    return segments.groupBy("doc_id", "segment_id").agg(best).select("doc_id", "segment_id", "s.row_id")


def completed_ids(checkpoints: DataFrame) -> DataFrame:
    """doc_id, segment_id of every completed segment of any run."""
    return checkpoints.select("doc_id", F.explode("completed_segments").alias("segment_id")).where("segment_id is not null").distinct()


def failures(checkpoints: DataFrame) -> DataFrame:
    """doc_id, segment_id, error, timestamp of every recorded failure."""
    return checkpoints.select("doc_id", F.explode("failed_segments").alias("f")).select("doc_id", "f.segment_id", "f.error", "f.timestamp")


def pending(segments: DataFrame, checkpoints: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Segments still to translate: not completed, or completed with failed or no content.

    One row a key, with all columns or ``columns``, of which ``translated_text`` must be one. The completed set drops what failed, so both reasons are one left join with a test.
    """
    done = completed_ids(checkpoints).withColumn("__done", F.lit(True))
    joined = latest_segments(segments, columns).join(done, ["doc_id", "segment_id"], "left")
    return joined.where(F.col("__done").isNull() | ~is_success("translated_text")).withColumn(
        "why", F.when(F.col("__done").isNull(), "not completed").otherwise("failed content")
    ).drop("__done")


def mark(checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """Checkpoints after events (doc_id, segment_id, event, error, timestamp; event completed, removed or failed).

    The last event of a segment counts, by timestamp, then by kind and error. A completed segment leaves the failures;
    a failed or removed one leaves the completed set.
    """
    last = events.groupBy("doc_id", "segment_id").agg(F.max_by(F.struct("event", "error", "timestamp"), F.struct("timestamp", "event", "error")).alias("e"))
    old = completed_ids(checkpoints).join(last.select("doc_id", "segment_id"), ["doc_id", "segment_id"], "left_anti")
    done = old.unionByName(last.where("e.event = 'completed'").select("doc_id", "segment_id"))
    kept = failures(checkpoints).join(last.select("doc_id", "segment_id"), ["doc_id", "segment_id"], "left_anti")
    failed = kept.unionByName(last.where("e.event = 'failed'").select("doc_id", "segment_id", "e.error", "e.timestamp"))
    per_done = done.groupBy("doc_id").agg(F.array_sort(F.collect_set("segment_id")).alias("completed_segments"))
    per_failed = failed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", "error", "timestamp"))).alias("failed_segments"))
    heads = checkpoints.groupBy("doc_id").agg(F.max("total_segments").alias("total_segments"), F.min("start_time").alias("start_time"), F.max("last_update").alias("last_update"))
    news = last.groupBy("doc_id").agg(F.max("e.timestamp").alias("__new"))
    out = heads.join(news, "doc_id", "full").join(per_done, "doc_id", "left").join(per_failed, "doc_id", "left")
    return out.select(
        "doc_id", F.coalesce("completed_segments", F.array().cast("array<bigint>")).alias("completed_segments"),
        F.coalesce("failed_segments", F.array().cast("array<struct<segment_id:bigint,error:string,timestamp:string>>")).alias("failed_segments"),
        "total_segments", "start_time", F.greatest("last_update", "__new").alias("last_update"),
    )


def progress(checkpoints: DataFrame) -> DataFrame:
    """For each document: completed, failed, total, pending and percent done (0 if there is nothing to do)."""
    one = checkpoints.select(
        "doc_id", F.size(F.array_distinct(F.coalesce("completed_segments", F.array().cast("array<bigint>")))).cast("bigint").alias("n_completed"),
        F.size(F.coalesce("failed_segments", F.array().cast("array<struct<segment_id:bigint,error:string,timestamp:string>>"))).cast("bigint").alias("n_failed"),
        F.coalesce("total_segments", F.lit(0)).cast("bigint").alias("total"),
    )
    summed = one.groupBy("doc_id").agg(F.sum("n_completed").alias("n_completed"), F.sum("n_failed").alias("n_failed"), F.max("total").alias("total"))
    return summed.withColumn("n_pending", F.col("total") - F.col("n_completed")).withColumn(
        "percent", F.when(F.col("total") > 0, F.round(100 * F.col("n_completed") / F.col("total"), 2)).otherwise(0.0)
    )


def translated_counts(segments: DataFrame) -> DataFrame:
    """For each document: rows, translated by the model's view, successful by the loops' view, blocked."""
    return segments.groupBy("doc_id").agg(
        F.count("*").alias("n_segments"), F.count_if(is_translated("translated_text")).alias("n_translated"),
        F.count_if(is_success("translated_text")).alias("n_success"), F.count_if(is_blocked("translated_text")).alias("n_blocked"),
    )


def blocked_records(segments: DataFrame, stamp: str) -> DataFrame:
    """Records of blocked segments for the log: originals shortened, the marker as the reason."""
    rows = segments.where(is_blocked("translated_text"))
    return rows.select("doc_id", "segment_id", "page_index", "chapter_title", abridged("original_text").alias("original_text"), F.col("translated_text").alias("reason"), F.lit(stamp).alias("timestamp"))


def append_blocked(log: DataFrame, segments: DataFrame, stamp: str) -> DataFrame:
    return log.unionByName(blocked_records(segments, stamp))


def batches(segments: DataFrame, size: int, tie: list[str] = ["row_id"]) -> DataFrame:  # noqa: B006
    """``batch_no`` from 1: consecutive segments of a document by the size; ``vision`` if any of the batch is an image."""
    numbered = row_numbers(segments, "doc_id", "segment_id", "__n", tie)
    out = numbered.withColumn("batch_no", (F.floor((F.col("__n") - 1) / size) + 1).cast("bigint")).drop("__n")
    routed = out.groupBy("doc_id", "batch_no").agg(F.bool_or(F.col("content_type") == "image").alias("vision"))
    return out.join(routed, ["doc_id", "batch_no"])


def preamble(segments: DataFrame, ratio: float = 0.1, tie: list[str] = ["row_id"]) -> DataFrame:  # noqa: B006
    """The first share of each document's segments, one at least."""
    counts = segments.groupBy("doc_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") * ratio)).alias("__head"))
    numbered = row_numbers(segments, "doc_id", "segment_id", "__n", tie)
    return numbered.join(counts, "doc_id").where(F.col("__n") <= F.col("__head")).drop("__n", "__head")


def clear_preamble(segments: DataFrame, ratio: float = 0.1, tie: list[str] = ["row_id"]) -> DataFrame:  # noqa: B006
    """Segments with the translations of the preamble emptied, to be made again with the glossary."""
    counts = segments.groupBy("doc_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") * ratio)).alias("__head"))
    numbered = row_numbers(segments, "doc_id", "segment_id", "__n", tie).join(counts, "doc_id")
    emptied = F.when((F.col("__n") <= F.col("__head")) & is_translated("translated_text"), "").otherwise(F.col("translated_text"))
    return numbered.withColumn("translated_text", emptied).drop("__n", "__head")


def checkpoint_batches(batched: DataFrame, interval: int = 10) -> DataFrame:
    """The batches after which a checkpoint is written: every ``interval``-th of a document, and its last."""
    last = batched.groupBy("doc_id").agg(F.max("batch_no").alias("__last"))
    each = batched.select("doc_id", "batch_no").distinct().join(last, "doc_id")
    return each.where((F.col("batch_no") % interval == 0) | (F.col("batch_no") == F.col("__last"))).drop("__last")
