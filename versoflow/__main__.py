"""Command line: a document in, its translation as Markdown out, with a stub backend unless another is given."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import functions as F

from versoflow.config import Settings, parse_margins, parse_page_range
from versoflow.operators.translate import BACKENDS, translate
from versoflow.session import local_session, ship
from versoflow.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="versoflow", description=__doc__)
    p.add_argument("file")
    p.add_argument("--config", help="file of KEY=value settings")
    p.add_argument("--out", default="output")
    p.add_argument("--page-range", type=parse_page_range)
    p.add_argument("--margins", type=parse_margins)
    p.add_argument("--backend", default="identity", help="a stub by name, or module:Class")
    p.add_argument("--extractor", help="module:Class for paged formats")
    p.add_argument("--toc", help="CSV file of contents")
    p.add_argument("--retain-original", action=argparse.BooleanOptionalAction, default=None)
    return p


def _made(name: str):
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    settings = Settings.from_env_file(args.config) if args.config else Settings()
    settings = settings.with_(document_path=args.file, **({} if args.retain_original is None else {"retain_original": args.retain_original}))
    spark = local_session()
    ship(spark)
    segments = readers.load_document(
        spark, args.file, extractor=_made(args.extractor) if args.extractor else None, toc_path=args.toc, page_range=args.page_range or settings.page_range,
        margins=args.margins or settings.margins, use_breadcrumb=settings.use_breadcrumb, max_chunk=settings.max_chunk_size,
    ).withColumn("row_id", F.col("segment_id"))
    backend = BACKENDS[args.backend]() if args.backend in BACKENDS else _made(args.backend)
    done = translate(segments, backend, settings.effective_batch_size)
    titles = done.select("doc_id").distinct().select("doc_id", F.lit(args.file).alias("title"), F.lit(args.file).alias("translated_title"))
    parts = sinks.markdown_parts(done, titles, use_breadcrumb=settings.use_breadcrumb, retain_original=settings.retain_original, page_markers=settings.page_markers)
    sinks.write_markdown(parts, args.out)


if __name__ == "__main__":
    main()
