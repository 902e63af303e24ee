"""Cutting ordered units of content into segments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoflow.functions.text import is_blank
from versoflow.operators.ordered import forward_fill, preceding, running_sum
from versoflow.operators.toc import DEFAULT_TITLE
from versoflow.session import materialize

MAX_CHUNK = 2000


def in_page_range(units: DataFrame, page_range: tuple[int, int] | None) -> DataFrame:
    """Units of pages in a range (from 1, inclusive), clamped to each document; pushed down to the scan."""
    if page_range is None:
        return units
    start, end = page_range
    return units.where((F.col("page_index") >= max(0, start - 1)) & (F.col("page_index") < end))


def with_chapters(units: DataFrame, chapters: DataFrame, default_title: str = DEFAULT_TITLE) -> DataFrame:
    """Units with the chapter they fall in, and whether it changes there.

    Blank units go first, so a chapter that starts at one is lost. Text units look up their key; image units never
    do. ``section`` counts the changes of chapter in the document, ``starts`` is true where one happens.
    """
    units = units.where((F.col("content_type") == "image") | ~is_blank("content"))
    return units.join(_sections(units, chapters, default_title).drop("n", "image"), ["doc_id", "pos"])


def _sections(units: DataFrame, chapters: DataFrame, default_title: str = DEFAULT_TITLE) -> DataFrame:
    """doc_id, pos, n (characters), image, chapter_title, toc_level, starts, section.

    The order-dependent steps read their input more than once, so they run on these narrow columns, written once.
    """
    known = chapters.select(F.col("doc_id").alias("__d"), F.col("key").alias("__key"), F.col("title").alias("found_title"), F.col("level").alias("found_level"))
    looked = units.join(known, (units.doc_id == known["__d"]) & (units.unit_key == known["__key"]) & (units.content_type == "text"), "left")
    slim = looked.select("doc_id", "pos", F.char_length("content").alias("n"), (F.col("content_type") == "image").alias("image"), "found_title", "found_level")
    filled = forward_fill(materialize(slim), "doc_id", "pos", ["found_title", "found_level"])
    filled = filled.withColumn("chapter_title", F.coalesce("found_title", F.lit(default_title))).withColumn("toc_level", F.coalesce("found_level", F.lit(1)))
    before = preceding(filled, "doc_id", "pos", F.col("chapter_title"), 1, "__before")
    starts = F.col("chapter_title") != F.coalesce(F.get("__before", F.lit(0)), F.lit(default_title))
    out = before.withColumn("starts", starts).drop("__before", "found_title", "found_level")
    return running_sum(out, "doc_id", "pos", F.col("starts").cast("int"), "section")


#: Sections that are folded together: a group holds so many chapters at most, whatever the size of its document.
SECTIONS = 64


def _fold(lengths: list[int], sections: list[int], images: list[bool], most: int) -> list[int]:
    """Chunk number of each unit: a chunk ends when its lengths reach the limit, its section changes, or an image comes."""
    out, chunk, size, section, open_ = [], 0, 0, None, False
    for n, s, image in zip(lengths, sections, images):
        if open_ and (s != section or image):
            chunk, size, open_ = chunk + 1, 0, False
        out.append(chunk)
        section, size, open_ = s, size + n, True
        if image or size >= most:
            chunk, size, open_ = chunk + 1, 0, False
    return out


def _chunks(sections: DataFrame, max_chunk: int) -> DataFrame:
    """``chunk`` of each unit (doc_id, pos, n, image, section and what else it has).

    The fold needs units in order, but only their lengths: the texts stay where they are. A chunk never crosses a section,
    so every SECTIONS sections are folded apart, and their chunks are numbered on by sums of counts.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        pdf["chunk"] = _fold(pdf["n"].fillna(0).astype(int).tolist(), pdf["section"].tolist(), pdf["image"].fillna(False).tolist(), max_chunk)
        return pdf

    sections = sections.withColumn("__part", F.floor(F.col("section") / SECTIONS))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sections.schema)
    folded = materialize(sections.groupBy("doc_id", "__part").applyInPandas(fold, kinds + ", chunk bigint"))
    counts = folded.groupBy("doc_id", "__part").agg((F.max("chunk") + 1).alias("__count"))
    first = running_sum(counts, "doc_id", "__part", F.col("__count"), "__upto").select("doc_id", "__part", (F.col("__upto") - F.col("__count")).alias("__first"))
    return folded.join(first, ["doc_id", "__part"]).withColumn("chunk", F.col("chunk") + F.col("__first")).drop("__first", "__part")


def segments_from_units(units: DataFrame, chapters: DataFrame, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """Segments: units joined by blank lines up to the chunk limit, never across a change of chapter.

    Segment ids count from 0 in reading order; a segment's page is the last that its units name; the first segment behind a
    change of chapter is marked. Image units become segments of their own, with the default title and unmarked.
    """
    units = units.where((F.col("content_type") == "image") | ~is_blank("content"))
    chunked = units.join(_chunks(_sections(units, chapters), max_chunk), ["doc_id", "pos"])
    image = F.col("content_type") == "image"
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~image, F.struct("pos", "content")))), lambda u: u["content"]), "\n\n")
    return chunked.groupBy("doc_id", F.col("chunk").alias("segment_id")).agg(
        whole.alias("original_text"),
        F.lit("").alias("translated_text"),
        (F.bool_or("starts") & ~F.bool_or(image)).alias("is_new_chapter"),
        F.when(F.bool_or(image), DEFAULT_TITLE).otherwise(F.max_by("chapter_title", "pos")).alias("chapter_title"),
        F.coalesce(F.max_by("page_index", F.when(F.col("page_index").isNotNull(), F.col("pos"))), F.lit(0)).alias("page_index"),
        F.when(F.bool_or(image), 1).otherwise(F.max_by("toc_level", "pos")).alias("toc_level"),
        F.max_by("content_type", "pos").alias("content_type"),
        F.max(F.when(image, F.col("content"))).alias("image_path"),
        F.count("*").alias("n_units"),
    )


CHUNKS = "doc_id bigint, segment_id bigint, n_units int, n_chars int, original_text string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("segment_id", pa.int64()), ("n_units", pa.int32()), ("n_chars", pa.int32()), ("original_text", pa.string())])


def chunk_texts(documents: DataFrame, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """Whole texts, one a row, cut at line ends into segments: the same fold, without any shuffle.

    Blank lines are left out; null and blank texts have no segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part: list[str] = []
                size = n = 0
                for line in (text or "").split("\n"):
                    if not line.strip():
                        continue
                    part.append(line)
                    size += len(line)
                    if size >= max_chunk:
                        rows.append((doc_id, n, len(part), size, "\n\n".join(part)))
                        part, size, n = [], 0, n + 1
                if part:
                    rows.append((doc_id, n, len(part), size, "\n\n".join(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, CHUNKS)


def reject_invalid(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason): images need a path, text must not have one."""
    reason = F.when((F.col("content_type") == "image") & is_blank("image_path"), "image without path").when(
        (F.col("content_type") == "text") & ~is_blank("image_path"), "text with path"
    )
    marked = segments.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
