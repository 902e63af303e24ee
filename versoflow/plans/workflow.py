"""Queries on status, glossaries, titles, matching and cached contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoflow import config
from versoflow.functions import text as T
from versoflow.operators import cache, glossary, matching, status, titles
from versoflow.plans.common import LATEST, WS, blank_sql, read, strip_sql, success_sql, translated_sql
from versoflow.sources import state


def translated_progress(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each book that count as translated by the one view and as successful by the other."""
    return status.translated_counts(read(spark, d, "segments"))


TRANSLATED_PROGRESS = f"""SELECT doc_id, count(*) AS n_segments, count_if({translated_sql('translated_text')}) AS n_translated, count_if({success_sql('translated_text')}) AS n_success,
    count_if(starts_with(coalesce(translated_text, ''), '[Failed: Blocked')) AS n_blocked FROM segments GROUP BY doc_id"""


def checkpoint_progress(spark: SparkSession, d: str) -> DataFrame:
    """Completed, failed, pending and percent of each book by its checkpoints."""
    return status.progress(read(spark, d, "checkpoints"))


CHECKPOINT_PROGRESS = """SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_completed, CAST(sum(f) AS BIGINT) AS n_failed, max(t) AS total, CAST(max(t) - sum(c) AS BIGINT) AS n_pending,
    CASE WHEN max(t) > 0 THEN round(100 * sum(c) / max(t), 2) ELSE 0.0 END AS percent
FROM (SELECT doc_id, len(list_distinct(coalesce(completed_segments, []))) AS c, len(coalesce(failed_segments, [])) AS f, coalesce(total_segments, 0) AS t FROM checkpoints) GROUP BY doc_id"""


def pending_segments(spark: SparkSession, d: str) -> DataFrame:
    """Current segments that aren't completed, or whose content failed."""
    return status.pending(read(spark, d, "segments"), read(spark, d, "checkpoints"), ["translated_text"]).select("doc_id", "segment_id", "why")


PENDING_SEGMENTS = f"""WITH {LATEST}, done AS (
    SELECT DISTINCT doc_id, unnest(completed_segments) AS segment_id FROM checkpoints
) SELECT l.doc_id, l.segment_id, CASE WHEN d.segment_id IS NULL THEN 'not completed' ELSE 'failed content' END AS why
FROM latest l LEFT JOIN done d ON d.doc_id = l.doc_id AND d.segment_id = l.segment_id WHERE d.segment_id IS NULL OR NOT {success_sql('l.translated_text')}"""


def current_segments(spark: SparkSession, d: str) -> DataFrame:
    """The row of each (book, segment) that was loaded last."""
    return status.latest_segments(read(spark, d, "segments")).select("doc_id", "segment_id", "row_id", F.md5("translated_text").alias("md5"))


CURRENT_SEGMENTS = f"WITH {LATEST} SELECT doc_id, segment_id, row_id, md5(translated_text) AS md5 FROM latest"


def recorded_failures(spark: SparkSession, d: str) -> DataFrame:
    """Every failure in the checkpoints."""
    return status.failures(read(spark, d, "checkpoints"))


RECORDED_FAILURES = """SELECT doc_id, f.segment_id AS segment_id, f.error AS error, f.timestamp AS "timestamp" FROM (SELECT doc_id, unnest(failed_segments) AS f FROM checkpoints)"""


def resumed_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints after a further run: what is successful now is completed, the rest has failed."""
    rows = status.latest_segments(read(spark, d, "segments"))
    good = T.is_success("translated_text")
    events = rows.select("doc_id", "segment_id", F.when(good, "completed").otherwise("failed").alias("event"), F.when(~good, "no content").alias("error"), F.lit("2030-01-01T00:00:00").alias("timestamp"))
    out = status.mark(read(spark, d, "checkpoints"), events)
    return out.select("doc_id", F.size("completed_segments").alias("n_completed"), F.size("failed_segments").alias("n_failed"), "last_update")


RESUMED_CHECKPOINTS = f"""WITH {LATEST}, now AS (SELECT doc_id, segment_id, {success_sql('translated_text')} AS good FROM latest),
done AS (
    SELECT DISTINCT doc_id, segment_id FROM (SELECT doc_id, unnest(completed_segments) AS segment_id FROM checkpoints) c WHERE NOT EXISTS (SELECT 1 FROM now n WHERE n.doc_id = c.doc_id AND n.segment_id = c.segment_id)
    UNION SELECT doc_id, segment_id FROM now WHERE good
), failed AS (
    SELECT doc_id, segment_id FROM (SELECT doc_id, unnest(failed_segments).segment_id AS segment_id FROM checkpoints) c WHERE NOT EXISTS (SELECT 1 FROM now n WHERE n.doc_id = c.doc_id AND n.segment_id = c.segment_id)
    UNION ALL SELECT doc_id, segment_id FROM now WHERE NOT good
), docs AS (SELECT doc_id FROM checkpoints UNION SELECT doc_id FROM now)
SELECT x.doc_id, CAST((SELECT count(*) FROM done y WHERE y.doc_id = x.doc_id) AS INT) AS n_completed, CAST((SELECT count(*) FROM failed y WHERE y.doc_id = x.doc_id) AS INT) AS n_failed,
    greatest((SELECT max(last_update) FROM checkpoints c WHERE c.doc_id = x.doc_id), (SELECT CASE WHEN count(*) > 0 THEN '2030-01-01T00:00:00' END FROM now n WHERE n.doc_id = x.doc_id)) AS last_update
FROM docs x"""


def blocked_log_appended(spark: SparkSession, d: str) -> DataFrame:
    """The log of blocked segments with those of the current rows added."""
    rows = status.latest_segments(read(spark, d, "segments"))
    return status.append_blocked(read(spark, d, "blocked_log"), rows, "2030-01-01T00:00:00").select("doc_id", "segment_id", "page_index", "reason", "timestamp", F.md5("original_text").alias("md5"))


BLOCKED_LOG_APPENDED = f"""WITH {LATEST}
SELECT doc_id, segment_id, page_index, reason, "timestamp", md5(original_text) AS md5 FROM blocked_log
UNION ALL SELECT doc_id, segment_id, page_index, translated_text, '2030-01-01T00:00:00', md5(CASE WHEN length(original_text) > 1000 THEN left(original_text, 1000) || '...' ELSE original_text END)
FROM latest WHERE starts_with(translated_text, '[Failed: Blocked')"""


def glossary_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Each term's last translation, with the place of its first."""
    return glossary.merged(read(spark, d, "glossary_batch"), ["source_lang", "target_lang"])


_TERMS = f"(SELECT * REPLACE ({strip_sql('term')} AS term, {strip_sql('translation')} AS translation) FROM glossary_batch WHERE NOT {blank_sql('term')} AND NOT {blank_sql('translation')})"
GLOSSARY_LAST_WINS = f"""SELECT source_lang, target_lang, term, last_t AS translation, first_b AS first_batch, first_o AS first_ord, n AS n_given FROM (
    SELECT *, first_value(translation) OVER (w ORDER BY batch_id DESC, ord DESC, translation DESC) AS last_t, first_value(batch_id) OVER (w ORDER BY batch_id, ord) AS first_b,
        first_value(ord) OVER (w ORDER BY batch_id, ord) AS first_o, count(*) OVER (w) AS n, row_number() OVER (w ORDER BY batch_id, ord) AS k
    FROM {_TERMS} WINDOW w AS (PARTITION BY source_lang, target_lang, term)) WHERE k = 1"""


def glossary_saturation(spark: SparkSession, d: str) -> DataFrame:
    """New terms of each batch, and where glossary building stops."""
    out = glossary.saturation(read(spark, d, "glossary_batch"), 100, 5000, 0.6)
    return out.select("batch_id", "new_terms", "total_terms", F.round("mean_last", 6).alias("mean_last"), "stops", "used")


GLOSSARY_SATURATION = f"""WITH terms AS (SELECT batch_id, {strip_sql('term')} AS term FROM glossary_batch WHERE NOT {blank_sql('term')}),
fresh AS (SELECT batch_id, count(*) AS n FROM (SELECT term, min(batch_id) AS batch_id FROM terms GROUP BY term) GROUP BY batch_id),
per AS (SELECT b.batch_id, coalesce(f.n, 0) AS new_terms FROM (SELECT DISTINCT batch_id FROM glossary_batch WHERE batch_id IS NOT NULL) b LEFT JOIN fresh f USING (batch_id)),
seen AS (SELECT *, CAST(sum(new_terms) OVER w AS BIGINT) AS total_terms, count(*) OVER w AS k, avg(new_terms) OVER w AS mean_all,
    avg(new_terms) OVER (ORDER BY batch_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean_last FROM per WINDOW w AS (ORDER BY batch_id ROWS UNBOUNDED PRECEDING)),
low AS (SELECT *, CASE WHEN total_terms >= 100 AND k >= 3 THEN CASE WHEN mean_last < mean_all * 0.6 THEN 1 ELSE 0 END END AS state FROM seen),
stop AS (SELECT *, total_terms >= 5000 OR (coalesce(state, 0) = 1 AND coalesce(last_value(state IGNORE NULLS) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1) AS stops FROM low)
SELECT batch_id, new_terms, total_terms, round(mean_last, 6) AS mean_last, stops,
    coalesce(max(CAST(stops AS INT)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS used FROM stop"""


def glossary_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Each language pair's glossary as a bullet list."""
    merged = glossary.merged(read(spark, d, "glossary_batch"), ["source_lang", "target_lang"])
    return glossary.as_list(merged, ["source_lang", "target_lang"]).select("source_lang", "target_lang", F.md5("glossary_text").alias("md5"), "n_terms")


GLOSSARY_PROMPT = f"""SELECT source_lang, target_lang, md5(string_agg('- **' || term || '**: ' || translation, chr(10) ORDER BY first_batch, first_ord, term)) AS md5, count(*) AS n_terms
FROM ({GLOSSARY_LAST_WINS}) GROUP BY source_lang, target_lang"""


def glossary_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first ten terms."""
    return glossary.first_terms(glossary.merged(read(spark, d, "glossary_batch")), 10).select("term", "translation")


GLOSSARY_PREVIEW = f"""SELECT term, last_t AS translation FROM (
    SELECT *, first_value(translation) OVER (PARTITION BY term ORDER BY batch_id DESC, ord DESC, translation DESC) AS last_t, row_number() OVER (PARTITION BY term ORDER BY batch_id, ord) AS k FROM {_TERMS})
WHERE k = 1 ORDER BY batch_id, ord, term LIMIT 10"""


def extraction_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text that each book's terms are taken from."""
    return glossary.extraction_text(status.latest_segments(read(spark, d, "segments"))).select("doc_id", F.md5("extraction_text").alias("md5"))


EXTRACTION_TEXTS = f"""WITH {LATEST} SELECT doc_id, md5(left(string_agg('Original: ' || {strip_sql('original_text')} || chr(10) || 'Translation: ' || {strip_sql('translated_text')}, chr(10) || chr(10) ORDER BY segment_id), 8000)) AS md5
FROM latest WHERE {translated_sql('translated_text')} AND NOT {blank_sql('original_text')} GROUP BY doc_id"""


def ordered_distinct_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles to translate, each once a book."""
    return titles.candidates(read(spark, d, "segments"))


ORDERED_DISTINCT_TITLES = f"""SELECT doc_id, chapter_title AS title, min(segment_id) AS first_segment, count(*) AS n_chapters FROM segments
WHERE coalesce(is_new_chapter, false) AND NOT {blank_sql('chapter_title')} AND NOT regexp_matches(chapter_title, '[\\x{{4e00}}-\\x{{9fff}}]') GROUP BY doc_id, chapter_title"""


def title_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Rows with their titles translated (here: put in quotes)."""
    rows = read(spark, d, "segments")
    done = titles.candidates(rows).select("title").distinct().select("title", F.concat(F.lit("»"), "title", F.lit("«")).alias("translated_title"))
    return titles.backfill(rows, done).select("row_id", "chapter_title")


TITLE_BACKFILL = f"""WITH t AS (SELECT DISTINCT chapter_title AS title, '»' || chapter_title || '«' AS up FROM segments
    WHERE coalesce(is_new_chapter, false) AND NOT {blank_sql('chapter_title')} AND NOT regexp_matches(chapter_title, '[\\x{{4e00}}-\\x{{9fff}}]'))
SELECT row_id, coalesce(up, chapter_title) AS chapter_title FROM segments LEFT JOIN t ON title = chapter_title"""


def _map(spark: SparkSession, d: str) -> DataFrame:
    return matching.translation_map(status.latest_segments(read(spark, d, "segments")))


def translation_map(spark: SparkSession, d: str) -> DataFrame:
    """The first translation of each normalised text or paragraph."""
    return _map(spark, d).select(F.md5("key").alias("key_md5"), F.md5("translation").alias("translation_md5"))


_NORM = lambda x: f"regexp_replace({strip_sql(x)}, '{WS}+', ' ', 'g')"
_PARTS = lambda x: f"list_transform(list_filter(string_split({strip_sql(x)}, chr(10) || chr(10)), lambda p: NOT {blank_sql('p')}), lambda p: {strip_sql('p')})"
_MAP_SQL = f"""{LATEST}, texts AS (
    SELECT doc_id, segment_id, row_id, {strip_sql('original_text')} AS original, {strip_sql('translated_text')} AS translated, {_PARTS('original_text')} AS o, {_PARTS('translated_text')} AS t
    FROM latest WHERE content_type = 'text' AND NOT {blank_sql('original_text')} AND NOT {blank_sql('translated_text')}
), entries AS (
    SELECT doc_id, segment_id, row_id, 0 AS rank, original, translated FROM texts
    UNION ALL
    SELECT doc_id, segment_id, row_id, k, o[k], CASE WHEN k = len(o) AND len(t) > k THEN array_to_string(t[k:], chr(10) || chr(10)) ELSE t[k] END
    FROM (SELECT *, unnest(range(1, len(o) + 1)) AS k FROM texts WHERE len(o) > 1)
), keyed AS (
    SELECT {_NORM('original')} AS key, translated, doc_id, segment_id, row_id, rank FROM entries WHERE translated IS NOT NULL
), mapped AS (
    SELECT key, translated AS translation, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, segment_id, row_id, rank) AS n, row_number() OVER (ORDER BY doc_id, segment_id, row_id, rank) AS place FROM keyed WHERE key <> '') WHERE n = 1
)"""
TRANSLATION_MAP = f"WITH {_MAP_SQL} SELECT md5(key) AS key_md5, md5(translation) AS translation_md5 FROM mapped"


def exact_match(spark: SparkSession, d: str) -> DataFrame:
    """Originals in the log of blocked segments that have a translation elsewhere, word for word."""
    blocks = read(spark, d, "blocked_log").select("doc_id", "segment_id", F.col("original_text").alias("text"))
    return matching.exact_match(blocks, _map(spark, d)).select("doc_id", "segment_id", F.md5("translation").alias("md5"))


EXACT_MATCH = f"WITH {_MAP_SQL} SELECT b.doc_id, b.segment_id, md5(m.translation) AS md5 FROM blocked_log b LEFT JOIN mapped m ON m.key = {_NORM('b.original_text')}"


def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Originals in the log of blocked segments with the most similar text that has a translation."""
    rows = read(spark, d, "blocked_log").where("doc_id is not null and segment_id is not null")
    blocks = rows.select((F.col("doc_id") * 1000003 + F.col("segment_id")).alias("block_id"), F.col("original_text").alias("text")).distinct()
    segments = read(spark, d, "segments")
    # of equal texts the earliest wins as well without a table of distinct keys, so no text of the segments is shuffled
    matched = matching.fuzzy_match(blocks, matching.entries(segments), "block_id", live=status.latest_ids(segments))
    return matched.select("block_id", F.md5("key").alias("md5"), F.round("score", 6).alias("score"))


_SIM = """CASE WHEN (length(a) < 50 OR length(key) < 50) AND CASE WHEN length(a) <= length(key) THEN contains(key, a) ELSE contains(a, key) END
    THEN least(length(a), length(key)) / greatest(length(a), length(key))
    ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END"""
_CJK = "regexp_matches({0}, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]')"
FUZZY_MATCH = f"""WITH {_MAP_SQL}, blocks AS (
    SELECT DISTINCT doc_id * 1000003 + segment_id AS block_id, {_NORM('original_text')} AS a FROM blocked_log WHERE doc_id IS NOT NULL AND segment_id IS NOT NULL
), pairs AS (
    SELECT block_id, a, key, place, {_CJK.format('a')} OR {_CJK.format('key')} AS cjk FROM blocks, mapped WHERE length(a) >= 10 AND length(key) >= 10
), sets AS (
    SELECT *, CASE WHEN cjk THEN list_distinct(string_split(replace(a, ' ', ''), '')) ELSE list_distinct(string_split(lower(a), ' ')) END AS x,
        CASE WHEN cjk THEN list_distinct(string_split(replace(key, ' ', ''), '')) ELSE list_distinct(string_split(lower(key), ' ')) END AS y FROM pairs
), scored AS (SELECT block_id, key, place, {_SIM} AS score FROM sets)
SELECT block_id, md5(key) AS md5, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY score DESC, place) AS n FROM scored WHERE score > 0.85) WHERE n = 1"""


#: Cached contexts made from the events: kind by user, lifetime by the event's properties.
NOW = 1704931200.0


def _entries(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("system_caches", "glossary_caches", "context_caches", "uploaded_files")])
    ttl = (F.get_json_object("props", "$.k").cast("int") % 7).cast("double")
    created = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    kind = F.get(kinds, (F.col("user_id") % 4).cast("int"))
    return read(spark, d, "events").select(
        kind.alias("type"), F.col("event_id").cast("string").alias("key"), F.concat(F.lit("cache/"), F.col("event_id").cast("string")).alias("cache_name"),
        F.md5(F.col("user_id").cast("string")).alias("content_hash"), created.alias("created_at"),
        F.when(kind != cache.LASTING, cache.expiry(created, ttl * 24)).alias("expiry_time"), (ttl * 24).alias("ttl_hours"),
    )


_ENTRIES = """entries AS (
    SELECT ['system_caches', 'glossary_caches', 'context_caches', 'uploaded_files'][CAST(user_id % 4 AS INT) + 1] AS type, CAST(event_id AS VARCHAR) AS key, 'cache/' || event_id AS cache_name,
        md5(CAST(user_id AS VARCHAR)) AS content_hash, epoch_us(ts) / 1e6 AS created_at,
        CASE WHEN user_id % 4 <> 3 THEN epoch_us(ts) / 1e6 + (CAST(props ->> '$.k' AS INT) % 7) * 24.0 * 3600 END AS expiry_time FROM events
)"""
_LIVE = f"(type = 'uploaded_files' OR coalesce(expiry_time > {NOW}, true))"


def cache_ttl_active(spark: SparkSession, d: str) -> DataFrame:
    """Cached contexts still within their lifetime."""
    return cache.listing(_entries(spark, d), NOW).select("type", "key", "is_expired")


CACHE_TTL_ACTIVE = f"WITH {_ENTRIES} SELECT type, key, false AS is_expired FROM entries WHERE {_LIVE}"


def cache_stats_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Cached contexts by type, and of all."""
    return cache.statistics(_entries(spark, d), NOW)


CACHE_STATS_ROLLUP = f"WITH {_ENTRIES} SELECT type, count(*) AS total, count_if({_LIVE}) AS active, count_if(NOT {_LIVE}) AS expired FROM entries GROUP BY ROLLUP (type)"


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For every hash the first live context."""
    entries = _entries(spark, d)
    return cache.lookup(entries.select("content_hash").distinct(), entries, NOW)


CACHE_LOOKUP = f"""WITH {_ENTRIES} SELECT h.content_hash, f.cache_name FROM (SELECT DISTINCT content_hash FROM entries) h LEFT JOIN (
    SELECT content_hash, cache_name, row_number() OVER (PARTITION BY content_hash ORDER BY created_at, key) AS n FROM entries WHERE {_LIVE}) f ON f.content_hash = h.content_hash AND f.n = 1"""


def cache_to_create(spark: SparkSession, d: str) -> DataFrame:
    """Hashes without a live context, each once."""
    entries = _entries(spark, d)
    return cache.to_create(entries, entries, NOW)


CACHE_TO_CREATE = f"WITH {_ENTRIES} SELECT DISTINCT content_hash FROM entries WHERE content_hash NOT IN (SELECT content_hash FROM entries WHERE {_LIVE})"


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys under which the contexts would be registered."""
    day = F.col("ts").cast("timestamp")
    return read(spark, d, "events").select("event_id", cache.cache_key("sys", day, None, F.md5(F.col("user_id").cast("string"))).alias("cache_key"))


CACHE_KEYS = "SELECT event_id, 'sys_' || strftime(ts, '%Y%m%d') || '_' || left(md5(CAST(user_id AS VARCHAR)), 8) AS cache_key FROM events"


def valid_modes(spark: SparkSession, d: str) -> DataFrame:
    """The modes that are complete."""
    return state.valid_modes(read(spark, d, "modes"))


VALID_MODES = f"SELECT mode_id, name, role_desc, style, context_len FROM modes WHERE NOT {blank_sql('mode_id')} AND NOT {blank_sql('name')} AND NOT {blank_sql('role_desc')}"


def book_modes(spark: SparkSession, d: str) -> DataFrame:
    """The mode of every book, where it has none the first."""
    modes = state.valid_modes(read(spark, d, "modes")).select("mode_id", "name", "style")
    first = state.choose_mode(modes).select(F.struct("mode_id", "name", "style").alias("f"))
    joined = read(spark, d, "books").join(F.broadcast(modes), "mode_id", "left").crossJoin(F.broadcast(first))  # modes are a small fixed table, first is one row
    return joined.select("doc_id", F.coalesce("name", "f.name").alias("mode_name"), F.coalesce("style", "f.style").alias("style"))


BOOK_MODES = "SELECT b.doc_id, coalesce(m.name, f.name) AS mode_name, coalesce(m.style, f.style) AS style FROM books b LEFT JOIN modes m USING (mode_id), (SELECT * FROM modes ORDER BY mode_id LIMIT 1) f"

def service_settings(spark: SparkSession, d: str) -> DataFrame:
    """Books by service, and the batch size that the service's requests hold."""
    rows = read(spark, d, "books").groupBy("service").agg(F.count("*").alias("n_books"))
    sizes = F.create_map(*[F.lit(x) for k in config.SERVICE_LIMITS for x in (k, config.safe_batch_size(5, 2000, k))])
    kind = F.when(F.col("service") == "gemini", "gemini").when(F.col("service").isin("openai", "deepseek"), "openai").otherwise("other")
    return rows.select("service", "n_books", F.try_element_at(sizes, kind).alias("batch_size"))


SERVICE_SETTINGS = "SELECT service, count(*) AS n_books, CASE WHEN service = 'gemini' THEN 4 WHEN service IN ('openai', 'deepseek') THEN 3 ELSE 5 END AS batch_size FROM books GROUP BY service"


def last_rendered_segment(spark: SparkSession, d: str) -> DataFrame:
    """The last segment that a book's rendering with marks has: where to go on."""
    rows = status.latest_segments(read(spark, d, "segments"), [])
    # the mark of one segment a row: a book's rendering is never gathered
    marked = rows.withColumn("markdown", F.concat(F.lit("text\n🔖 **Segment "), F.col("segment_id").cast("string"), F.lit("**\nmore")))
    return marked.groupBy("doc_id").agg(F.max(T.last_segment_id("markdown")).alias("last_segment"))


LAST_RENDERED_SEGMENT = "SELECT doc_id, max(segment_id) AS last_segment FROM segments GROUP BY doc_id"

def toc_titles_translated(spark: SparkSession, d: str) -> DataFrame:
    """Contents titles with their translations, found by normalised text among the chapter titles (here: in quotes)."""
    known = titles.candidates(read(spark, d, "segments")).select("title").distinct()
    mapping = known.groupBy(T.normalize("title").alias("key")).agg(F.min(F.concat(F.lit("»"), "title", F.lit("«"))).alias("translation"))
    items = read(spark, d, "toc_items").select("doc_id", "ord", F.col("title").alias("text"))
    return matching.exact_match(items, mapping).select("doc_id", "ord", "translation")


TOC_TITLES_TRANSLATED = f"""WITH t AS (SELECT {_NORM('chapter_title')} AS key, min('»' || chapter_title || '«') AS translation FROM segments
    WHERE coalesce(is_new_chapter, false) AND NOT {blank_sql('chapter_title')} AND NOT regexp_matches(chapter_title, '[\\x{{4e00}}-\\x{{9fff}}]') GROUP BY 1)
SELECT doc_id, ord, translation FROM toc_items LEFT JOIN t ON t.key = {_NORM('title')}"""


def glossary_hash(spark: SparkSession, d: str) -> DataFrame:
    """The hash under which a glossary is cached, whatever its order."""
    return cache.glossary_hash(glossary.merged(read(spark, d, "glossary_batch"))).select("n_terms", "content_hash")


GLOSSARY_HASH = f"""SELECT count(*) AS n_terms, md5(string_agg(h, '' ORDER BY h)) AS content_hash FROM (
    SELECT md5(CAST(json_object('term', term, 'translation', translation) AS VARCHAR)) AS h FROM (SELECT term, arg_max(translation, (batch_id, ord, translation)) AS translation FROM {_TERMS} GROUP BY term))"""

QUERIES = {
    f.__name__: f
    for f in (
        toc_titles_translated, glossary_hash, service_settings, last_rendered_segment, translated_progress, checkpoint_progress, pending_segments, current_segments, recorded_failures, resumed_checkpoints, blocked_log_appended,
        glossary_last_wins, glossary_saturation, glossary_prompt, glossary_preview, extraction_texts, ordered_distinct_titles, title_backfill,
        translation_map, exact_match, fuzzy_match, cache_ttl_active, cache_stats_rollup, cache_lookup, cache_to_create, cache_keys, valid_modes, book_modes,
    )
}
SQL = {
    "toc_titles_translated": TOC_TITLES_TRANSLATED, "glossary_hash": GLOSSARY_HASH,
    "service_settings": SERVICE_SETTINGS, "last_rendered_segment": LAST_RENDERED_SEGMENT,
    "translated_progress": TRANSLATED_PROGRESS, "checkpoint_progress": CHECKPOINT_PROGRESS, "pending_segments": PENDING_SEGMENTS, "current_segments": CURRENT_SEGMENTS,
    "recorded_failures": RECORDED_FAILURES, "resumed_checkpoints": RESUMED_CHECKPOINTS, "blocked_log_appended": BLOCKED_LOG_APPENDED, "glossary_last_wins": GLOSSARY_LAST_WINS,
    "glossary_saturation": GLOSSARY_SATURATION, "glossary_prompt": GLOSSARY_PROMPT, "glossary_preview": GLOSSARY_PREVIEW, "extraction_texts": EXTRACTION_TEXTS,
    "ordered_distinct_titles": ORDERED_DISTINCT_TITLES, "title_backfill": TITLE_BACKFILL, "translation_map": TRANSLATION_MAP, "exact_match": EXACT_MATCH, "fuzzy_match": FUZZY_MATCH,
    "cache_ttl_active": CACHE_TTL_ACTIVE, "cache_stats_rollup": CACHE_STATS_ROLLUP, "cache_lookup": CACHE_LOOKUP, "cache_to_create": CACHE_TO_CREATE, "cache_keys": CACHE_KEYS,
    "valid_modes": VALID_MODES, "book_modes": BOOK_MODES,
}
