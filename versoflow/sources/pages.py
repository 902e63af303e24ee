"""Page-level sources. Page extraction and typesetting libraries are not part of this package: they plug in here."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoflow.config import crop_box
from versoflow.functions.text import is_blank


class PageExtractor(Protocol):
    """What a library for a paged format must offer."""

    def pages(self, content: bytes) -> list[tuple[float, float]]:
        """Width and height of each page."""

    def text(self, content: bytes, page: int, box: tuple[float, float, float, float]) -> str:
        """Text of a page within a rectangle, in reading order."""

    def contents(self, content: bytes) -> list[tuple[int, str, int]]:
        """(level, title, page from 1) of the contents the file itself has."""


def scan_pages(files: DataFrame, extractor: PageExtractor, page_range: tuple[int, int] | None = None, margins=None) -> DataFrame:
    """Units of the files' pages (doc_id, content): pages in range only are opened; a page that fails has empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    sizes = extractor.pages(bytes(r.content))
                except Exception:
                    continue
                start, end = (0, len(sizes)) if page_range is None else (max(0, page_range[0] - 1), min(len(sizes), page_range[1]))
                for page in range(start, end):
                    try:
                        text = extractor.text(bytes(r.content), page, crop_box(*sizes[page], margins)).strip()
                    except Exception:
                        text = ""
                    rows.append((r.doc_id, page, str(page), page, text, "text"))
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "unit_key", "page_index", "content", "content_type"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id bigint, pos bigint, unit_key string, page_index int, content string, content_type string")


def native_contents(files: DataFrame, extractor: PageExtractor) -> DataFrame:
    """doc_id, ord, level, title, key (page from 0) of the files' own contents; entries before page 1 are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    listed = extractor.contents(bytes(r.content))
                except Exception:
                    continue
                rows += [(r.doc_id, k, level, title, str(page - 1)) for k, (level, title, page) in enumerate(listed) if page >= 1]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "level", "title", "key"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id bigint, ord int, level int, title string, key string")


def page_images(units: DataFrame, folder: str, existing: DataFrame | None = None) -> DataFrame:
    """Image units with the path that each page's picture has; of ``existing`` paths nothing is to be written again."""
    path = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("doc_id").cast("string"), F.lit("_page_"), F.format_string("%04d", F.col("page_index") + 1), F.lit(".jpg"))
    out = units.withColumn("image_path", path)
    return out if existing is None else out.join(existing.select(F.col("path").alias("image_path")), "image_path", "left_anti")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (from the content's MD5), path, content, sha256 of files."""
    files = spark.read.format("binaryFile").load(path)
    digest = F.md5("content")
    return files.select(F.conv(F.left(digest, F.lit(15)), 16, 10).cast("bigint").alias("doc_id"), "path", "content", digest.alias("md5"), F.sha2("content", 256).alias("sha256"))


def units_from_texts(documents: DataFrame, text: str = "text") -> DataFrame:
    """Units from texts, one a row: their lines that aren't blank, in order."""
    each = documents.select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "content"))
    return each.where(~is_blank("content")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.lit(None).cast("string").alias("unit_key"), F.lit(None).cast("int").alias("page_index"), "content", F.lit("text").alias("content_type"))
