"""Tables of contents: heading paths, chapter maps, and the choice among sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoflow.functions.text import is_blank, strip, strip_fragment, url_unquote
from versoflow.operators.ordered import row_numbers

DEFAULT_TITLE = "前言/未命名章节"


def heading_paths(toc: DataFrame, separator: str = " > ", max_level: int = 64) -> DataFrame:
    """Each item with the path of titles above it.

    A stack is cut to one less than an item's level when it is as deep, then the item is pushed; a skipped level
    leaves no gap. So an item's path is, for every level up to its own, the last item that still stands: it is
    found without a stack, as the last earlier item of lower level that no later one has displaced.

    Levels below 1 count as 1, null levels as 1, null titles as empty. Ties of ``ord`` go by title.
    """
    items = toc.select("doc_id", "ord", F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)).alias("level"), strip(F.coalesce("title", F.lit(""))).alias("title"), "key")
    # a book's contents list is one small row: a fold over (level, title) pairs inside the JVM
    lists = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "level", "key"))).alias("items"))
    stack, paths = "array<string>", "array<string>"
    start = F.struct(F.array().cast(stack).alias("stack"), F.array().cast(paths).alias("paths"))

    def step(acc, x):
        kept = F.when(F.size(acc["stack"]) >= x["level"], F.slice(acc["stack"], F.lit(1), x["level"] - 1)).otherwise(acc["stack"])
        now = F.concat(kept, F.array(x["title"]))
        return F.struct(now.alias("stack"), F.concat(acc["paths"], F.array(F.array_join(now, separator))).alias("paths"))

    folded = lists.withColumn("path", F.aggregate("items", start, step, lambda acc: acc["paths"]))
    each = folded.select("doc_id", F.explode(F.arrays_zip("items", "path")).alias("x"))
    return each.select("doc_id", F.col("x.items.ord").alias("ord"), F.col("x.items.level").alias("level"), F.col("x.items.title").alias("title"), F.col("x.items.key").alias("key"), F.col("x.path").alias("path"))


def chapter_map(toc: DataFrame, use_breadcrumb: bool = True) -> DataFrame:
    """doc_id, key, title, level: the first item of each key. With breadcrumbs titles are paths and levels 1.

    Keys lose their fragment and percent-escapes; items without a key are left out.
    """
    paths = heading_paths(toc).withColumn("key", url_unquote(strip_fragment("key"))).where("key is not null")
    first = paths.groupBy("doc_id", "key").agg(F.min_by(F.struct("title", "path", "level"), F.struct("ord", "title")).alias("x"))
    title, level = ("x.path", F.lit(1)) if use_breadcrumb else ("x.title", F.col("x.level"))
    return first.select("doc_id", "key", F.col(title).alias("title"), level.cast("int").alias("level"))


def spine_fallback(spine: DataFrame) -> DataFrame:
    """Contents from the spine of a container that lists none: every document but the navigation, at level 1."""
    kept = spine.where(~F.contains(F.lower("name"), F.lit("nav")))
    numbered = row_numbers(kept, "doc_id", "pos", "n")
    return numbered.select("doc_id", (F.col("n") - 1).cast("int").alias("ord"), F.lit(1).alias("level"), F.concat(F.lit("Section: "), F.col("name")).alias("title"), F.col("name").alias("key"))


def first_source(*sources: DataFrame) -> DataFrame:
    """For each document the contents of the first source that has any."""
    ranked = None
    for k, s in enumerate(sources):
        one = s.select("doc_id", "ord", "level", "title", "key", F.lit(k).alias("source"))
        ranked = one if ranked is None else ranked.unionByName(one)
    best = ranked.groupBy("doc_id").agg(F.min("source").alias("source"))
    return ranked.join(best, ["doc_id", "source"], "left_semi").drop("source")


def csv_items(rows: DataFrame) -> DataFrame:
    """Contents from rows of a CSV file (string columns page, title, level; pages from 1).

    Rows without a page are left out, and those before page 1. Missing titles and levels get ``Page n`` and 1. If
    any page or level of a document isn't a whole number, the document has no contents from this source.
    """
    given = rows.where(~is_blank("page"))
    page, level = F.try_cast(strip("page"), "int") if hasattr(F, "try_cast") else strip("page").try_cast("int"), strip("level").try_cast("int")
    parsed = given.select(
        "doc_id", "ord", page.alias("page"), F.when(is_blank("level"), F.lit(1)).otherwise(level).alias("level"), strip("title").alias("title"),
    )
    bad = parsed.where("page is null or level is null").select("doc_id").distinct()
    kept = parsed.join(bad, "doc_id", "left_anti").where("page >= 1")
    title = F.when(is_blank("title"), F.concat(F.lit("Page "), F.col("page").cast("string"))).otherwise(F.col("title"))
    return kept.select("doc_id", "ord", "level", title.alias("title"), (F.col("page") - 1).cast("string").alias("key"))
