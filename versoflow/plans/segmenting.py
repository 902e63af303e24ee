"""Queries on units, chapters, contents and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoflow.functions import text as T
from versoflow.operators import context, ordered, segment, status, toc
from versoflow.plans.common import LATEST, WS, blank_sql, read, strip_sql, translated_sql
from versoflow.sources import pages


def chunk_segments(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut at line ends into segments of about 2,000 characters: units, blank filter, fold, join."""
    chunks = segment.chunk_texts(read(spark, d, "documents"))
    return chunks.select("doc_id", "segment_id", "n_units", "n_chars", T.content_hash("original_text").alias("md5"))


CHUNK_SEGMENTS = f"""
WITH RECURSIVE lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
), units AS (
    SELECT doc_id, line, length(line) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM lines WHERE NOT {blank_sql('line')}
), fold AS (
    SELECT doc_id, k, line, 0 AS chunk, n AS size, n >= 2000 AS full_ FROM units WHERE k = 1
    UNION ALL
    SELECT u.doc_id, u.k, u.line, f.chunk + CASE WHEN f.full_ THEN 1 ELSE 0 END, CASE WHEN f.full_ THEN u.n ELSE f.size + u.n END,
        CASE WHEN f.full_ THEN u.n ELSE f.size + u.n END >= 2000
    FROM fold f JOIN units u ON u.doc_id = f.doc_id AND u.k = f.k + 1
)
SELECT doc_id, CAST(chunk AS BIGINT) AS segment_id, CAST(count(*) AS INT) AS n_units, CAST(sum(length(line)) AS INT) AS n_chars,
    md5(string_agg(line, chr(10) || chr(10) ORDER BY k)) AS md5
FROM fold GROUP BY doc_id, chunk
"""


def _units(spark: SparkSession, d: str) -> DataFrame:
    """The current segments as units: reading order by segment, the page as the key of paged books."""
    rows = status.latest_segments(read(spark, d, "segments"))
    return rows.select(
        "doc_id", F.col("segment_id").alias("pos"), F.col("page_index").cast("string").alias("unit_key"), "page_index",
        F.coalesce("original_text", F.lit("")).alias("content"), "content_type",
    )


def chapter_units(spark: SparkSession, d: str) -> DataFrame:
    """Units joined with the chapter map, chapters carried forward, changes marked and counted."""
    chapters = toc.chapter_map(read(spark, d, "toc_items"))
    out = segment.with_chapters(_units(spark, d), chapters)
    return out.select("doc_id", "pos", "chapter_title", F.col("toc_level").cast("int").alias("toc_level"), "starts", F.col("section").cast("bigint").alias("section"))


_PATHS = f"""items AS (
    SELECT doc_id, ord, greatest(coalesce(level, 1), 1) AS level, {strip_sql("coalesce(title, '')")} AS title, key,
        row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM toc_items
), stack AS (
    SELECT doc_id, ord, level, title, key, k, [title] AS path FROM items WHERE k = 1
    UNION ALL
    SELECT i.doc_id, i.ord, i.level, i.title, i.key, i.k, list_append(CASE WHEN len(s.path) >= i.level THEN s.path[1:i.level - 1] ELSE s.path END, i.title)
    FROM stack s JOIN items i ON i.doc_id = s.doc_id AND i.k = s.k + 1
)"""
_MAP = f"""{_PATHS}, keyed AS (
    SELECT doc_id, ord, array_to_string(path, ' > ') AS path, url_decode(replace(string_split(key, '#')[1], '+', '%2B')) AS key FROM stack WHERE key IS NOT NULL
), chapters AS (
    SELECT doc_id, key, arg_min(path, ord) AS title FROM keyed GROUP BY doc_id, key
)"""
_FILLED = f"""units AS (
    SELECT doc_id, segment_id AS pos, CAST(page_index AS VARCHAR) AS unit_key, coalesce(original_text, '') AS content, content_type FROM latest
    WHERE content_type = 'image' OR NOT {blank_sql('original_text')}
), looked AS (
    SELECT u.*, c.title AS found FROM units u LEFT JOIN chapters c ON c.doc_id = u.doc_id AND c.key = u.unit_key AND u.content_type = 'text'
), filled AS (
    SELECT *, coalesce(last_value(found IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), '{toc.DEFAULT_TITLE}') AS chapter_title FROM looked
), marked AS (
    SELECT *, chapter_title <> coalesce(lag(chapter_title) OVER (PARTITION BY doc_id ORDER BY pos), '{toc.DEFAULT_TITLE}') AS starts FROM filled
), sectioned AS (
    SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM marked
)"""
CHAPTER_UNITS = f"WITH RECURSIVE {LATEST}, {_MAP}, {_FILLED} SELECT doc_id, pos, chapter_title, 1 AS toc_level, starts, CAST(section AS BIGINT) AS section FROM sectioned"


def chunk_segments_by_chapter(spark: SparkSession, d: str) -> DataFrame:
    """Segments from units: folded by length, never across a change of chapter; images stand alone."""
    chapters = toc.chapter_map(read(spark, d, "toc_items"))
    out = segment.segments_from_units(_units(spark, d), chapters)
    return out.select(
        "doc_id", "segment_id", T.content_hash("original_text").alias("md5"), "is_new_chapter", "chapter_title", "page_index", F.col("content_type"), F.col("n_units").cast("bigint").alias("n_units")
    )


CHUNK_BY_CHAPTER = f"""
WITH RECURSIVE {LATEST}, {_MAP}, {_FILLED}, ordered AS (
    SELECT s.*, length(s.content) AS n, s.content_type = 'image' AS image, row_number() OVER (PARTITION BY s.doc_id ORDER BY pos) AS k, l.page_index
    FROM sectioned s JOIN latest l ON l.doc_id = s.doc_id AND l.segment_id = s.pos
), fold AS (
    SELECT doc_id, k, CAST(0 AS BIGINT) AS chunk, n AS size, (image OR n >= 2000) AS full_, section FROM ordered WHERE k = 1
    UNION ALL
    SELECT o.doc_id, o.k, f.chunk + CASE WHEN f.full_ OR o.section <> f.section OR o.image THEN 1 ELSE 0 END,
        CASE WHEN f.full_ OR o.section <> f.section OR o.image THEN o.n ELSE f.size + o.n END,
        o.image OR CASE WHEN f.full_ OR o.section <> f.section OR o.image THEN o.n ELSE f.size + o.n END >= 2000, o.section
    FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.k = f.k + 1
)
SELECT o.doc_id, f.chunk AS segment_id, md5(coalesce(string_agg(o.content, chr(10) || chr(10) ORDER BY o.k) FILTER (WHERE NOT o.image), '')) AS md5,
    bool_or(o.starts) AND NOT bool_or(o.image) AS is_new_chapter,
    CASE WHEN bool_or(o.image) THEN '{toc.DEFAULT_TITLE}' ELSE arg_max(o.chapter_title, o.k) END AS chapter_title,
    coalesce(arg_max(o.page_index, o.k), 0) AS page_index, arg_max(o.content_type, o.k) AS content_type, count(*) AS n_units
FROM ordered o JOIN fold f ON f.doc_id = o.doc_id AND f.k = o.k GROUP BY o.doc_id, f.chunk
"""


def toc_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    """Every contents item with the path of titles above it."""
    return toc.heading_paths(read(spark, d, "toc_items")).select("doc_id", "ord", "level", "title", "path")


TOC_BREADCRUMBS = f"WITH RECURSIVE {_PATHS} SELECT doc_id, ord, level, title, array_to_string(path, ' > ') AS path FROM stack"


def toc_chapter_map(spark: SparkSession, d: str) -> DataFrame:
    """The first item of each key, keys without fragments and escapes."""
    return toc.chapter_map(read(spark, d, "toc_items")).select("doc_id", "key", "title")


TOC_CHAPTER_MAP = f"WITH RECURSIVE {_MAP} SELECT doc_id, key, title FROM chapters"


def toc_levels_kept(spark: SparkSession, d: str) -> DataFrame:
    """The chapter map without paths: plain titles and their own levels."""
    return toc.chapter_map(read(spark, d, "toc_items"), use_breadcrumb=False)


TOC_LEVELS_KEPT = f"""WITH RECURSIVE {_PATHS}, keyed AS (
    SELECT doc_id, ord, title, level, url_decode(replace(string_split(key, '#')[1], '+', '%2B')) AS key FROM stack WHERE key IS NOT NULL
) SELECT doc_id, key, arg_min(title, ord) AS title, CAST(arg_min(level, ord) AS INT) AS level FROM keyed GROUP BY doc_id, key"""


def toc_spine_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Contents made from file names where a container has none."""
    spine = read(spark, d, "toc_items").where("key is not null").select("doc_id", F.col("ord").cast("bigint").alias("pos"), T.strip_fragment("key").alias("name"))
    return toc.spine_fallback(spine.where(F.endswith("name", F.lit(".xhtml"))))


TOC_SPINE_FALLBACK = """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS ord, 1 AS level, 'Section: ' || name AS title, name AS key
FROM (SELECT doc_id, ord AS pos, string_split(key, '#')[1] AS name FROM toc_items WHERE key IS NOT NULL)
WHERE ends_with(name, '.xhtml') AND NOT contains(lower(name), 'nav')
"""


def toc_uids(spark: SparkSession, d: str) -> DataFrame:
    """An identifier for every contents item."""
    return read(spark, d, "toc_items").select("doc_id", "ord", T.toc_uid(F.coalesce("title", F.lit("")), F.col("ord")).alias("uid"))


TOC_UIDS = f"""SELECT doc_id, ord, CASE WHEN slug = '' THEN 'toc_item_' || ord ELSE 'toc_' || slug || '_' || ord END AS uid FROM (
    SELECT doc_id, ord, left(lower(regexp_replace({strip_sql(f"regexp_replace(coalesce(title, ''), '[^{chr(92)}p{{L}}{chr(92)}p{{N}}_{WS[1:-1]}-]', '', 'g')")}, '[{WS[1:-1]}-]+', '_', 'g')), 50) AS slug FROM toc_items)"""


def page_range_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows of pages 2 to 6 only: the test reaches the scan."""
    return segment.in_page_range(read(spark, d, "segments"), (2, 6)).select("row_id", "doc_id", "page_index")


PAGE_RANGE_SCAN = "SELECT row_id, doc_id, page_index FROM segments WHERE page_index >= 1 AND page_index < 6"


def text_units(spark: SparkSession, d: str) -> DataFrame:
    """Non-blank lines of documents with their places."""
    return pages.units_from_texts(read(spark, d, "documents")).select("doc_id", "pos", F.char_length("content").alias("n_chars"))


TEXT_UNITS = f"""SELECT doc_id, pos, n_chars FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos, CAST(length(line) AS INT) AS n_chars FROM documents WHERE text IS NOT NULL
) WHERE NOT {blank_sql('line')}"""


def invalid_segments(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose type and image path don't fit, with the reason."""
    return segment.reject_invalid(read(spark, d, "segments"))[1].select("row_id", "reason")


INVALID_SEGMENTS = f"""SELECT row_id, CASE WHEN content_type = 'image' THEN 'image without path' ELSE 'text with path' END AS reason FROM segments
WHERE (content_type = 'image' AND {blank_sql('image_path')}) OR (content_type = 'text' AND NOT {blank_sql('image_path')})"""


def prev_context(spark: SparkSession, d: str) -> DataFrame:
    """The end of the original before each row."""
    return context.previous_context(read(spark, d, "segments")).select("row_id", "context")


PREV_CONTEXT = f"""SELECT row_id, {strip_sql(f"right({strip_sql(chr(99))}, 500)")} AS context FROM (
    SELECT row_id, coalesce(lag(original_text) OVER (PARTITION BY doc_id ORDER BY segment_id, row_id), '') AS c FROM segments)"""


def context_window3(spark: SparkSession, d: str) -> DataFrame:
    """The translated ones of the three rows before each row."""
    return context.translated_window(read(spark, d, "segments")).select("row_id", F.col("window").alias("context_window"))


CONTEXT_WINDOW3 = f"""SELECT row_id, {strip_sql("coalesce(array_to_string(list_filter(list(t) OVER (PARTITION BY doc_id ORDER BY segment_id, row_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL), ' '), '')")} AS context_window
FROM (SELECT row_id, doc_id, segment_id, CASE WHEN {translated_sql('translated_text')} THEN {strip_sql('translated_text')} END AS t FROM segments)"""


def vision_running_context(spark: SparkSession, d: str) -> DataFrame:
    """The running context of image calls."""
    return context.vision_context(read(spark, d, "segments")).select("row_id", F.md5("running").alias("md5"))


VISION_RUNNING_CONTEXT = """SELECT row_id, md5(right(coalesce(array_to_string(list(t) OVER (PARTITION BY doc_id ORDER BY segment_id, row_id ROWS BETWEEN 501 PRECEDING AND 1 PRECEDING), chr(10)), ''), 500)) AS md5
FROM (SELECT row_id, doc_id, segment_id, coalesce(translated_text, '') AS t FROM segments)"""


def batch_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Batches of five of each book's rows, and whether any of a batch is an image."""
    return status.batches(read(spark, d, "segments"), 5).select("row_id", "batch_no", "vision")


BATCH_ASSIGNMENT = """SELECT row_id, batch_no, bool_or(content_type = 'image') OVER (PARTITION BY doc_id, batch_no) AS vision FROM (
    SELECT *, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY segment_id, row_id) - 1) // 5 + 1 AS BIGINT) AS batch_no FROM segments)"""


def checkpoint_cadence(spark: SparkSession, d: str) -> DataFrame:
    """Batches after which a checkpoint is written."""
    return status.checkpoint_batches(status.batches(read(spark, d, "segments"), 5), 10)


CHECKPOINT_CADENCE = """SELECT DISTINCT doc_id, batch_no FROM (
    SELECT doc_id, batch_no, max(batch_no) OVER (PARTITION BY doc_id) AS last FROM (
        SELECT doc_id, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY segment_id, row_id) - 1) // 5 + 1 AS BIGINT) AS batch_no FROM segments))
WHERE batch_no % 10 = 0 OR batch_no = last"""


def preamble_head(spark: SparkSession, d: str) -> DataFrame:
    """The first tenth of each book."""
    return status.preamble(read(spark, d, "segments"), 0.1).select("row_id", "doc_id", "segment_id")


PREAMBLE_HEAD = """SELECT row_id, doc_id, segment_id FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY segment_id, row_id) AS n, greatest(1, floor(count(*) OVER (PARTITION BY doc_id) * 0.1)) AS head FROM segments) WHERE n <= head"""


def preamble_cleared(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose translation is emptied before the final pass, counted by book."""
    before = read(spark, d, "segments").select("row_id", F.col("translated_text").alias("was"))
    after = status.clear_preamble(read(spark, d, "segments"), 0.1)
    return after.join(before, "row_id").where((F.col("was") != "") & (F.col("translated_text") == "")).groupBy("doc_id").agg(F.count("*").alias("n_cleared"))


PREAMBLE_CLEARED = f"""SELECT doc_id, count(*) AS n_cleared FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY segment_id, row_id) AS n, greatest(1, floor(count(*) OVER (PARTITION BY doc_id) * 0.1)) AS head FROM segments)
WHERE n <= head AND {translated_sql('translated_text')} GROUP BY doc_id"""


def running_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each book up to and with each row."""
    rows = read(spark, d, "segments").select("row_id", "doc_id", "segment_id", "original_text")
    return ordered.running_sum(rows, "doc_id", "segment_id", F.char_length("original_text"), "chars_so_far", ["row_id"]).select("row_id", F.col("chars_so_far").cast("bigint").alias("chars_so_far"))


RUNNING_LENGTHS = "SELECT row_id, CAST(sum(coalesce(length(original_text), 0)) OVER (PARTITION BY doc_id ORDER BY segment_id, row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars_so_far FROM segments"

QUERIES = {
    f.__name__: f
    for f in (
        chunk_segments, chapter_units, chunk_segments_by_chapter, toc_breadcrumbs, toc_chapter_map, toc_levels_kept, toc_spine_fallback, toc_uids,
        page_range_scan, text_units, invalid_segments, prev_context, context_window3, vision_running_context, batch_assignment, checkpoint_cadence,
        preamble_head, preamble_cleared, running_lengths,
    )
}
SQL = {
    "chunk_segments": CHUNK_SEGMENTS, "chapter_units": CHAPTER_UNITS, "chunk_segments_by_chapter": CHUNK_BY_CHAPTER, "toc_breadcrumbs": TOC_BREADCRUMBS,
    "toc_chapter_map": TOC_CHAPTER_MAP, "toc_levels_kept": TOC_LEVELS_KEPT, "toc_spine_fallback": TOC_SPINE_FALLBACK, "toc_uids": TOC_UIDS, "page_range_scan": PAGE_RANGE_SCAN,
    "text_units": TEXT_UNITS, "invalid_segments": INVALID_SEGMENTS, "prev_context": PREV_CONTEXT, "context_window3": CONTEXT_WINDOW3,
    "vision_running_context": VISION_RUNNING_CONTEXT, "batch_assignment": BATCH_ASSIGNMENT, "checkpoint_cadence": CHECKPOINT_CADENCE,
    "preamble_head": PREAMBLE_HEAD, "preamble_cleared": PREAMBLE_CLEARED, "running_lengths": RUNNING_LENGTHS,
}
