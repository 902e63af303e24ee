"""Writing rendered documents."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoflow.functions.render import body_of, chapters_of, document_head, render_segments, styles_of
from versoflow.functions.text import clean_filename
from versoflow.sources.epub import rewrite_epub, write_epub


def markdown_parts(segments: DataFrame, titles: DataFrame, **how) -> DataFrame:
    """doc_id, part, markdown in reading order: part -1 is the head (titles: doc_id, title, translated_title)."""
    body = render_segments(segments, **how).select("doc_id", F.col("segment_id").alias("part"), "markdown")
    head = titles.select("doc_id", F.lit(-1).cast("bigint").alias("part"), document_head("translated_title", "title").alias("markdown"))
    return body.unionByName(head)


def write_markdown(parts: DataFrame, folder: str) -> None:
    """One folder a document, its parts in reading order as text files; no document's text meets in one row."""
    ordered = parts.repartitionByRange("doc_id", "part").sortWithinPartitions("doc_id", "part")
    # parts are divided by the line end that the next one begins with
    value = F.when((F.col("part") >= 0) & F.startswith("markdown", F.lit("\n")), F.expr("substring(markdown, 2)")).otherwise(F.col("markdown"))
    ordered.select("doc_id", value.alias("value")).write.mode("overwrite").partitionBy("doc_id").text(folder)


def write_new_epubs(htmls: DataFrame, folder: str) -> None:
    """An EPUB for each row (title, html), cut at its headings; folder is one that all workers reach."""
    rows = htmls.select(clean_filename("title").alias("name"), "title", chapters_of(body_of("html")).alias("chapters"), styles_of("html").alias("css"))

    def write(batch: Iterator) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in batch:
            with open(os.path.join(folder, f"{r.name}.epub"), "wb") as f:
                f.write(write_epub([(c.title, c.html) for c in r.chapters], r.title, css=r.css or ""))

    rows.foreachPartition(write)


def refilled_epub(content: bytes, pages: list[tuple[str, str]]) -> bytes:
    """The original container with its translated documents; documents without content are left out."""
    return rewrite_epub(content, {name: html for name, html in pages if html})
