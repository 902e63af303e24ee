"""Finding the translation of a block of text: exact after normalisation, else the most similar."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versoflow.functions.text import SPACE, is_blank, normalize, paragraphs, similarity, strip
from versoflow.operators.likeness import LIKE, near
from versoflow.session import materialize

#: Least length of both texts of a fuzzy match; its least similarity is LIKE, exclusive.
LEAST = 10
#: Numbers of texts that are broadcast to fetch them; beyond, the table is joined with them.
HELD_ROWS = 2_000_000
#: What names a row of segments.
ROW = ("doc_id", "segment_id", "row_id")


def entries(segments: DataFrame) -> DataFrame:
    """key, translation, at: whole texts and their paragraphs, normalised, with their places. Rows are cut where they are read.

    Order is by document, segment and row; a segment's whole text comes before its paragraphs. Paragraphs pair by
    place; surplus translated ones are put behind the last pair, unless the original is a single paragraph, whose
    translation is the whole already.
    """
    rows = segments.where((F.col("content_type") == "text") & ~is_blank("original_text") & ~is_blank("translated_text"))
    original, translated = strip("original_text"), strip("translated_text")
    # most texts are one paragraph: they are stripped once
    o, t = (F.when(F.contains(x, F.lit("\n\n")), F.transform(paragraphs(x), strip)).otherwise(F.array(x)) for x in (original, translated))
    cut = rows.select("doc_id", "segment_id", "row_id", original.alias("original"), translated.alias("translated"), o.alias("o"), t.alias("t"))
    n = F.size("o")
    rest = F.array_join(F.slice("t", n, F.greatest(F.lit(1), F.size("t") - n + 1)), "\n\n")
    paired = F.transform("o", lambda p, k: F.struct(
        (k + 1).alias("rank"), p.alias("original"),
        F.when((k == n - 1) & (F.size("t") > n), rest).otherwise(F.get("t", k)).alias("translated"),
    ))
    whole = F.array(F.struct(F.lit(0).alias("rank"), F.col("original").alias("original"), F.col("translated").alias("translated")))
    # a single paragraph is the whole text: nothing is added for it
    parts = F.when(n > 1, F.concat(whole, paired)).otherwise(whole)
    each = cut.select("doc_id", "segment_id", "row_id", F.explode(parts).alias("e")).where("e.translated is not null and e.original <> ''")
    key = F.regexp_replace("e.original", f"{SPACE}+", " ")  # normalised, since all are stripped
    return each.select(key.alias("key"), F.col("e.translated").alias("translation"), F.struct("doc_id", "segment_id", "row_id", "e.rank").alias("at"))


def translation_map(segments: DataFrame) -> DataFrame:
    """key -> translation of ``entries``; the first that has a key wins."""
    return entries(segments).groupBy("key").agg(F.min_by("translation", "at").alias("translation"), F.min("at").alias("at"))


def exact_match(blocks: DataFrame, mapping: DataFrame, text: str = "text") -> DataFrame:
    """Blocks with ``translation``, null where no entry has their normalised text."""
    known = mapping.select(F.col("key").alias("__key"), "translation")
    return blocks.join(known, normalize(text) == F.col("__key"), "left").drop("__key")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """``a``, ``key``: all pairs of texts (columns ``s``) whose similarity may be above LIKE, each once; see ``likeness``."""
    named = [df.select(F.xxhash64("s").alias(f"{x}_id"), F.col("s").alias(name)).distinct() for df, x, name in ((left, "left", "a"), (right, "right", "key"))]
    return near(left, right).join(named[0], "left_id").join(named[1], "right_id").select("a", "key")


def fuzzy_match(blocks: DataFrame, mapping: DataFrame, id_column: str, text: str = "text", live: DataFrame | None = None) -> DataFrame:
    """id, key, translation, score: for each block the most similar entry above 0.85, the earliest of equals.

    Texts of under LEAST characters match nothing. No pair is lost, see ``likeness``. ``mapping`` is read twice, for signatures
    and for the texts of the pairs they give: it is ``entries`` (keys may repeat) or a table that is written already. Where
    ``live`` (doc_id, segment_id, row_id) is given, entries of its rows alone count.
    """
    left = materialize(blocks.select(F.col(id_column).alias("__id"), normalize(text).alias("a")).where(F.char_length("a") >= LEAST))
    # no filter on the key here: it would be made once more for it
    right = mapping.select("key", "translation", "at")
    pairs = materialize(near(left.select(F.col("a").alias("s")), right.select(F.col("key").alias("s")), LEAST))
    wanted = pairs.select("right_id").distinct()
    found = right.withColumn("right_id", F.xxhash64("key")).join(F.broadcast(wanted) if wanted.count() <= HELD_ROWS else wanted, "right_id")
    if live is not None:
        rows = live.select(*[F.col(c).alias(f"__{c}") for c in ROW])
        # each entry has one such row at most; a semi-join would be moved before the join above
        found = found.join(rows.distinct(), reduce(and_, [F.col(f"at.{c}").eqNullSafe(F.col(f"__{c}")) for c in ROW]))
    scored = pairs.join(left.select(F.xxhash64("a").alias("left_id"), "a").distinct(), "left_id").join(found, "right_id")
    scored = scored.withColumn("score", F.when(F.char_length("key") >= LEAST, similarity("a", "key"))).where(F.col("score") > LIKE)
    best = scored.groupBy("a").agg(F.max_by(F.struct("key", "translation", "score"), F.struct("score", _earlier("at"))).alias("m"))
    return left.join(best, "a").select(F.col("__id").alias(id_column), "m.key", "m.translation", "m.score")


def _earlier(at: str) -> Column:
    """A struct that is greater for earlier places."""
    return F.struct(*[(-F.col(f"{at}.{f}")).alias(f) for f in ("doc_id", "segment_id", "row_id", "rank")])


def match(blocks: DataFrame, mapping: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """Exact matches, and fuzzy ones for the rest: id, translation, how (``exact``, ``fuzzy`` or null)."""
    mapping = materialize(mapping)
    exact = exact_match(blocks.select(id_column, text), mapping, text)
    hit = exact.where("translation is not null").select(id_column, "translation", F.lit("exact").alias("how"))
    miss = exact.where("translation is null").select(id_column, text)
    fuzzy = fuzzy_match(miss, mapping, id_column, text).select(id_column, "translation", F.lit("fuzzy").alias("how"))
    rest = miss.select(id_column).join(fuzzy.select(id_column), id_column, "left_anti").select(id_column, F.lit(None).cast("string").alias("translation"), F.lit(None).cast("string").alias("how"))
    return hit.unionByName(fuzzy).unionByName(rest)
