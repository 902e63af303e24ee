"""Resuming in a stream: segments come in, are translated batch by batch, and the status is kept exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from versoflow.functions.text import is_success
from versoflow.operators.translate import Backend, translate


def translate_stream(segments: DataFrame, backend: Backend, out: str, checkpoint: str, batch_size: int = 5, once: bool = True) -> StreamingQuery:
    """Translate new rows of a stream and write them to ``out``, a folder a micro-batch.

    A micro-batch that runs again after a failure overwrites its own folder, so results aren't doubled; which rows are
    done is known from the stream's checkpoint.
    """

    def write(df: DataFrame, epoch: int) -> None:
        done = translate(df, backend, batch_size).withColumn("epoch", F.lit(epoch)).withColumn("success", is_success("translated_text"))
        done.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    writer = segments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def current_status(results: DataFrame) -> DataFrame:
    """The last result of each segment among all micro-batches."""
    names = [c for c in results.columns if c not in ("doc_id", "segment_id")]
    best = F.max_by(F.struct(*names), F.struct("epoch")).alias("r")
    return results.groupBy("doc_id", "segment_id").agg(best).select("doc_id", "segment_id", *[F.col(f"r.{n}").alias(n) for n in names])
