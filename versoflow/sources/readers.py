"""Which reader a file gets, and using saved segments before parsing."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

from versoflow.errors import SourceError
from versoflow.operators.segment import segments_from_units
from versoflow.operators.toc import chapter_map, first_source
from versoflow.sources import epub, pages, state, toc_csv


def load_document(
    spark: SparkSession, path: str, cache: str | None = None, extractor: pages.PageExtractor | None = None, toc_path: str | None = None,
    page_range: tuple[int, int] | None = None, margins=None, use_breadcrumb: bool = True, max_chunk: int = 2000,
) -> DataFrame:
    """Segments of a document: those saved under ``cache`` if they can be read, else parsed and saved there.

    What is saved goes by the contents of the file and of its contents list, and by all settings.
    """
    if cache:
        given = [page_range, margins, use_breadcrumb, max_chunk, *(state.fingerprint(spark, p) for p in (path, toc_path) if p)]
        cache = f"{cache.rstrip('/')}/{hashlib.sha256(repr(given).encode()).hexdigest()[:32]}"
        if state.exists(spark, cache):
            return spark.read.parquet(cache)
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".epub":
        files = epub.read_epubs(spark, path)
        units, chapters = epub.units(files), epub.contents(files)
    elif suffix == ".pdf":
        if extractor is None:
            raise SourceError("a .pdf needs a page extractor", path=path)
        files = pages.read_files(spark, path)
        units = pages.scan_pages(files, extractor, page_range, margins)
        chapters = pages.native_contents(files, extractor)
        if toc_path:
            doc_id = files.select("doc_id").first()["doc_id"]
            chapters = first_source(toc_csv.read_toc_csv(spark, toc_path, doc_id), chapters)
    else:
        raise SourceError("documents are .pdf or .epub", path=path)
    segments = segments_from_units(units, chapter_map(chapters, use_breadcrumb), max_chunk)
    if cache:
        state.save(segments, cache)
        return spark.read.parquet(cache)
    return segments
