"""Queries on model replies, text functions, rendering and HTML; and the whole run with a stub backend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versoflow.functions import html as H
from versoflow.functions import prompts as P
from versoflow.functions import render as R
from versoflow.functions import repair as J
from versoflow.functions import text as T
from versoflow.operators import glossary, status, translate
from versoflow.plans.common import LATEST, WS, blank_sql, read, strip_sql
from versoflow.sources import sinks

#: Replies made from the whole texts of the current segments, five a batch, in six shapes by batch: an array, a fenced one,
#: one cut off, one in single quotes, one without its last item, and no JSON at all.
_CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
_ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def _escaped(text: Column, quote: str) -> Column:
    """A text as it stands between quotes; control characters that JSON forbids are left out."""
    out = F.regexp_replace(text, _CONTROL, "")
    for a, b in (*_ESCAPES, (quote, f"\\{quote}")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _escaped_sql(text: str, quote: str) -> str:
    out = f"regexp_replace({text}, '{_CONTROL}', '', 'g')"
    for a, b in (("chr(92)", "chr(92) || chr(92)"), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'"), ("chr(9)", "chr(92) || 't'"), (f"chr({ord(quote)})", f"chr(92) || chr({ord(quote)})")):
        out = f"replace({out}, {a}, {b})"
    return out


#: Undoing the escapes of a quoted reply, as the patterns' way does.
_UNESCAPED_SQL = "replace(replace(replace({0}, chr(92) || chr(34), chr(34)), chr(92) || chr(39), chr(39)), chr(92) || 'n', chr(10))"


def _responses(spark: SparkSession, d: str) -> DataFrame:
    rows = status.batches(status.latest_segments(read(spark, d, "segments"), ["row_id", "original_text", "content_type"]), 5)
    text = F.coalesce("original_text", F.lit(""))
    grouped = rows.groupBy("doc_id", F.col("batch_no").alias("batch_id")).agg(F.array_sort(F.collect_list(F.struct("segment_id", text.alias("t")))).alias("rows"))
    item = lambda r: F.concat(F.lit('{"id": '), r["segment_id"].cast("string"), F.lit(', "translation": "'), _escaped(r["t"], '"'), F.lit('"}'))
    quoted = lambda r: F.concat(F.lit("{'id': "), r["segment_id"].cast("string"), F.lit(", 'translation': '"), _escaped(r["t"], "'"), F.lit("'}"))
    whole = F.concat(F.lit("["), F.array_join(F.transform("rows", item), ", "), F.lit("]"))
    kind = (F.col("doc_id") + F.col("batch_id")) % 6
    raw = (
        F.when(kind == 0, whole)
        .when(kind == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(kind == 2, F.left(whole, (F.char_length(whole) * 2 / 3).cast("int")))
        .when(kind == 3, F.concat(F.lit("["), F.array_join(F.transform("rows", quoted), ", "), F.lit("]")))
        .when(kind == 4, F.concat(F.lit("["), F.array_join(F.transform(F.slice("rows", F.lit(1), F.size("rows") - 1), item), ", "), F.lit("]")))
        .otherwise("The service is busy.")
    )
    return grouped.select("doc_id", "batch_id", F.transform("rows", lambda r: r["segment_id"]).alias("expected_ids"), raw.alias("raw_text"))


_RESPONSES = f"""{LATEST}, batched AS (
    SELECT doc_id, segment_id, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY segment_id, row_id) - 1) // 5 + 1 AS BIGINT) AS batch_id,
        coalesce(original_text, '') AS t FROM latest
), grouped AS (
    SELECT doc_id, batch_id, list(segment_id ORDER BY segment_id) AS ids, list('{{"id": ' || segment_id || ', "translation": "' || {_escaped_sql('t', '"')} || '"}}' ORDER BY segment_id) AS items,
        list('{{''id'': ' || segment_id || ', ''translation'': ''' || {_escaped_sql('t', "'")} || '''}}' ORDER BY segment_id) AS quoted FROM batched GROUP BY doc_id, batch_id
), whole AS (SELECT *, '[' || array_to_string(items, ', ') || ']' AS w, (doc_id + batch_id) % 6 AS kind FROM grouped
), responses AS (
    SELECT doc_id, batch_id, ids, CASE kind WHEN 0 THEN w WHEN 1 THEN '```json' || chr(10) || w || chr(10) || '```' WHEN 2 THEN left(w, CAST(floor(length(w) * 2 / 3) AS INT))
        WHEN 3 THEN '[' || array_to_string(quoted, ', ') || ']' WHEN 4 THEN '[' || coalesce(array_to_string(items[1:len(items) - 1], ', '), '') || ']' ELSE 'The service is busy.' END AS raw FROM whole
), stripped AS (
    SELECT *, CASE WHEN regexp_matches(raw, '(?s)^```(?:json)?\\s*(.*)\\s*```$') THEN regexp_extract(raw, '(?s)^```(?:json)?\\s*(.*)\\s*```$', 1) ELSE raw END AS inner_ FROM responses
), routed AS (
    SELECT doc_id, batch_id, ids, raw, inner_, json_valid(inner_) AS strict,
        regexp_extract_all(raw, '{J.PAIR_PATTERNS[0]}', 1) AS i1, regexp_extract_all(raw, '{J.PAIR_PATTERNS[0]}', 2) AS t1,
        regexp_extract_all(raw, '{J.PAIR_PATTERNS[1]}', 1) AS i2, regexp_extract_all(raw, '{J.PAIR_PATTERNS[1]}', 2) AS t2,
        regexp_extract_all(raw, '{J.PAIR_PATTERNS[2].replace(chr(39), chr(39) * 2)}', 1) AS i3, regexp_extract_all(raw, '{J.PAIR_PATTERNS[2].replace(chr(39), chr(39) * 2)}', 2) AS t3,
        regexp_extract_all(raw, '{J.PAIR_PATTERNS[3]}', 1) AS i4, regexp_extract_all(raw, '{J.PAIR_PATTERNS[3]}', 2) AS t4 FROM stripped
), picked AS (
    SELECT doc_id, batch_id, ids, raw, CASE WHEN strict THEN 'strict' WHEN len(i1) + len(i2) + len(i3) + len(i4) > 0 THEN 'fallback' ELSE 'failed' END AS route,
        CASE WHEN strict THEN list_transform(from_json(inner_, '[{{"id":"BIGINT","translation":"VARCHAR"}}]'), lambda x: CAST(x.id AS VARCHAR)) WHEN len(i1) > 0 THEN i1 WHEN len(i2) > 0 THEN i2 WHEN len(i3) > 0 THEN i3 ELSE i4 END AS found,
        CASE WHEN strict THEN list_transform(from_json(inner_, '[{{"id":"BIGINT","translation":"VARCHAR"}}]'), lambda x: x.translation) WHEN len(i1) > 0 THEN t1 WHEN len(i2) > 0 THEN t2 WHEN len(i3) > 0 THEN t3 ELSE t4 END AS texts FROM routed
), asked AS (SELECT *, unnest(ids) AS segment_id FROM picked
), placed AS (SELECT *, list_position(list_reverse(found), CAST(segment_id AS VARCHAR)) AS back FROM asked
), got AS (
    SELECT * EXCLUDE (t), CASE WHEN route = 'fallback' THEN {_UNESCAPED_SQL.format('t')} ELSE t END AS t FROM (SELECT *, CASE WHEN back > 0 THEN texts[len(found) - back + 1] END AS t, back = 1 AS final_ FROM placed)
)"""
_PARSED = f"""SELECT doc_id, batch_id, segment_id, route, coalesce(
    CASE WHEN route = 'fallback' AND final_ AND NOT ends_with(regexp_replace(raw, '{WS}+$', ''), ']') AND t <> '' AND NOT regexp_matches(regexp_replace(t, '{WS}+$', ''), '{J.SENTENCE_END}') THEN t || '{J.CUT_MARK}' ELSE t END,
    CASE route WHEN 'strict' THEN '{T.MISSING_TRANSLATION}' WHEN 'fallback' THEN '{T.MISSING_IN_RESPONSE}' ELSE '{T.PARSE_ERROR}' END) AS translation FROM got"""


def response_parse(spark: SparkSession, d: str) -> DataFrame:
    """A translation or a marker for every id asked for, from replies of which many are broken."""
    return J.parse_responses(_responses(spark, d))


RESPONSE_PARSE = f"WITH {_RESPONSES} {_PARSED}"


def response_routes(spark: SparkSession, d: str) -> DataFrame:
    """How replies could be read, and what was missing in them."""
    parsed = J.parse_responses(_responses(spark, d))
    return parsed.groupBy("route").agg(F.count("*").alias("n_ids"), F.count_if(F.startswith("translation", F.lit("[Failed"))).alias("n_missing"))


RESPONSE_ROUTES = f"WITH {_RESPONSES} SELECT route, count(*) AS n_ids, count_if(starts_with(translation, '[Failed')) AS n_missing FROM ({_PARSED}) GROUP BY route"


def glossary_reply_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of glossary replies in dictionary form, cut off, so that only patterns can read them."""
    rows = read(spark, d, "glossary_batch").where("term is not null and translation is not null")
    body = F.transform(F.array_sort(F.collect_list(F.struct("ord", "term", "translation"))), lambda r: F.concat(F.lit('"'), r["term"], F.lit('": "'), r["translation"], F.lit('"')))
    raw = rows.groupBy("batch_id").agg(F.concat(F.lit('{"status": "ok", '), F.array_join(body, ", ")).alias("raw"))
    each = raw.select("batch_id", F.explode(J.fallback_entries(F.col("raw"))).alias("e"))
    return each.groupBy("batch_id", F.col("e.k").alias("term"), F.col("e.v").alias("translation")).agg(F.count("*").alias("n"))


GLOSSARY_REPLY_ENTRIES = "SELECT batch_id, term, translation, count(*) AS n FROM glossary_batch WHERE term IS NOT NULL AND translation IS NOT NULL AND term <> '' AND NOT lower(term) IN ('id', 'type', 'status', 'error') GROUP BY batch_id, term, translation"


def glossary_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Entries of glossary replies in three shapes by batch: a dictionary, a list of dictionaries, a list of pairs."""
    rows = read(spark, d, "glossary_batch").where("term is not null and translation is not null")
    each = F.array_sort(F.collect_list(F.struct("ord", "term", "translation")))
    pair = lambda a, m, z: F.array_join(F.transform("r", lambda x: F.concat(F.lit(a), _escaped(x["term"], '"'), F.lit(m), _escaped(x["translation"], '"'), F.lit(z))), ", ")
    kind = F.col("batch_id") % 3
    each_once = rows.groupBy("batch_id", "term").agg(F.min(F.struct("ord", "translation")).alias("x")).select("batch_id", "term", "x.ord", "x.translation")
    grouped = each_once.groupBy("batch_id").agg(each.alias("r"))
    raw = (
        F.when(kind == 0, F.concat(F.lit("{"), pair('"', '": "', '"'), F.lit("}")))
        .when(kind == 1, F.concat(F.lit("[{\"id\": \"1\"}, "), pair('{"', '": "', '"}'), F.lit("]")))
        .otherwise(F.concat(F.lit("["), pair('["', '", "', '"]'), F.lit("]")))
    )
    found = grouped.select("batch_id", F.explode(J.flat_entries(raw)).alias("e"))
    return found.select("batch_id", F.col("e.k").alias("term"), F.col("e.v").alias("translation")).distinct()


GLOSSARY_SHAPES = f"""SELECT DISTINCT batch_id, {strip_sql('term')} AS term, {strip_sql('translation')} AS translation FROM (
    SELECT batch_id, term, arg_min(translation, (ord, translation)) AS translation FROM glossary_batch WHERE term IS NOT NULL AND translation IS NOT NULL GROUP BY batch_id, term)
WHERE NOT {blank_sql('term')} AND NOT {blank_sql('translation')} AND lower({strip_sql('term')}) <> 'id'"""


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Characters of the whole prompt of every batch."""
    rows = status.latest_segments(read(spark, d, "segments"))
    return translate.prompt_lengths(translate.requests(rows, 5, glossary.merged(read(spark, d, "glossary_batch"))))


def system_instructions(spark: SparkSession, d: str) -> DataFrame:
    """The system instruction of every mode."""
    return read(spark, d, "modes").select("mode_id", F.md5(P.system_instruction("role_desc", "style")).alias("md5"))


SYSTEM_INSTRUCTIONS = f"""SELECT mode_id, md5('{P.BASE}' || chr(10) || chr(10) || '{P.TEXT_FORM}' || CASE WHEN NOT {blank_sql('role_desc')} THEN chr(10) || chr(10) || 'Role: ' || {strip_sql('role_desc')} ELSE '' END
    || CASE WHEN NOT {blank_sql('style')} THEN chr(10) || chr(10) || 'Style: ' || {strip_sql('style')} ELSE '' END) AS md5 FROM modes"""


def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    """The plain text functions over every row."""
    rows = read(spark, d, "segments")
    return rows.select(
        "row_id", F.md5(T.normalize("original_text")).alias("normalized_md5"), F.md5(T.clean_lines("original_text")).alias("lines_md5"), F.size(T.paragraphs("original_text")).alias("n_paragraphs"),
        T.has_chinese("original_text").alias("has_chinese"), T.has_cjk("original_text").alias("has_cjk"), T.content_hash("original_text").alias("content_hash"),
        T.clean_filename("chapter_title").alias("file_name"), F.md5(T.tail("original_text", 500)).alias("tail_md5"), F.md5(T.abridged("original_text", 200)).alias("abridged_md5"),
        F.md5(T.escape_html("chapter_title")).alias("escaped_md5"), T.is_heading_line("original_text").alias("is_heading"),
    )


TEXT_SCALARS = f"""SELECT row_id, md5(regexp_replace({strip_sql('original_text')}, '{WS}+', ' ', 'g')) AS normalized_md5,
    md5(array_to_string(list_filter(list_transform(string_split(original_text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> ''), chr(10) || chr(10))) AS lines_md5,
    CAST(len(list_filter(string_split(coalesce(original_text, ''), chr(10) || chr(10)), lambda x: NOT {blank_sql('x')})) AS INT) AS n_paragraphs,
    regexp_matches(original_text, '[\\x{{4e00}}-\\x{{9fff}}]') AS has_chinese, regexp_matches(original_text, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]') AS has_cjk, md5(original_text) AS content_hash,
    replace(regexp_replace(chapter_title, '[\\\\/*?:"<>|]', '', 'g'), ' ', '_') AS file_name, md5(right(original_text, 500)) AS tail_md5,
    md5(CASE WHEN length(original_text) > 200 THEN left(original_text, 200) || '...' ELSE original_text END) AS abridged_md5,
    md5(replace(replace(replace(replace(replace(chapter_title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_md5,
    starts_with({strip_sql('original_text')}, '#') AS is_heading FROM segments"""


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts made safe for layout."""
    return read(spark, d, "segments").select("row_id", F.md5(R.clean_text("original_text")).alias("md5"))


_BLANKS = "[ \\t　]"


def _clean_sql(x: str) -> str:
    line = f"""regexp_replace(replace(CASE WHEN regexp_matches(s, '^{_BLANKS}') THEN repeat(chr(160), (length(s) - length(regexp_replace(s, '^{_BLANKS}+', ''))) // 2 + 1) || regexp_replace(s, '^{_BLANKS}+', '') ELSE s END, '　', ' '), '[ \\t]{{2,}}', '  ', 'g')"""
    lines = f"list_transform(string_split(replace(replace(coalesce({x}, ''), chr(13), ''), '\\n', chr(10)), chr(10)), lambda s: {line})"
    return strip_sql(f"regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")


CLEAN_TEXT = f"SELECT row_id, md5({_clean_sql('original_text')}) AS md5 FROM segments"


def markdown_render(spark: SparkSession, d: str) -> DataFrame:
    """Every row as Markdown: translation only, with headings, page marks and pictures."""
    return R.render_segments(read(spark, d, "segments"), use_breadcrumb=False).select("row_id", F.md5("markdown").alias("md5"))


_HEADER = "starts_with({0}, '#')".format(strip_sql("s"))


def _markdown_sql(table: str, breadcrumb: bool) -> str:
    """Rows of a table with ``markdown``."""
    mode = "'breadcrumb'" if breadcrumb else "CASE WHEN bool_or(coalesce(is_new_chapter, false) AND coalesce(chapter_title, '') <> '') THEN 'normal' ELSE 'page_only' END"
    return f"""SELECT *, CASE WHEN content_type = 'image' THEN
    CASE WHEN coalesce(image_path, '') <> '' THEN chr(10) || chr(10) || '![Segment ' || segment_id || '](' || image_path || ')' || CASE WHEN NOT {blank_sql('translated_text')} THEN chr(10) || '> 💡 **图注/内容译文**' || chr(10) || '> ' || body ELSE '' END ELSE '' END
    || chr(10) || chr(10) || chr(10) || '---'
ELSE
    CASE WHEN coalesce(is_new_chapter, false) AND coalesce(chapter_title, '') <> '' THEN
        chr(10) || chr(10) || repeat('#', level + 1) || ' ' || CASE mode WHEN 'breadcrumb' THEN '🧭' WHEN 'page_only' THEN '🔖' ELSE ['📚', '📖', '📄', '📝', '📌'][level] END || ' ' || title || chr(10) || chr(10)
    WHEN page_index IS NOT NULL AND NOT coalesce(is_new_chapter, false) THEN chr(10) || chr(10) || '###### --- 原文第 ' || (page_index + 1) || ' 页 --- ' || chr(10) || chr(10) ELSE '' END
    || array_to_string(list_transform(string_split(body, chr(10)), lambda s: CASE WHEN {blank_sql('s')} THEN '' WHEN {_HEADER} THEN chr(10) || s || chr(10) ELSE s END), chr(10)) || chr(10) || chr(10) || '---'
END AS markdown FROM (
    SELECT s.*, mode, greatest(1, least(coalesce(nullif(toc_level, 0), 1), 5)) AS level, {_clean_sql('chapter_title')} AS title, {_clean_sql('translated_text')} AS body
    FROM {table} s JOIN (SELECT doc_id, {mode} AS mode FROM {table} GROUP BY doc_id) USING (doc_id))"""


MARKDOWN_RENDER = f"SELECT row_id, md5(markdown) AS md5 FROM ({_markdown_sql('segments', False)})"


def bilingual_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Every row with original and translation side by side."""
    return read(spark, d, "segments").select("row_id", F.md5(R.bilingual("original_text", "translated_text")).alias("md5"))


_PARAS = lambda x: f"list_filter(string_split({_clean_sql(x)}, chr(10) || chr(10)), lambda p: NOT {blank_sql('p')})"
BILINGUAL_PARAGRAPHS = f"""WITH p AS (SELECT row_id, {_PARAS('original_text')} AS o, {_PARAS('translated_text')} AS t FROM segments),
blocks AS (SELECT row_id, k, o[k] AS a, t[k] AS b FROM (SELECT *, unnest(range(1, greatest(len(o), len(t)) + 1)) AS k FROM p)),
parts AS (SELECT row_id, k, array_to_string(list_filter(list_concat(
    CASE WHEN b IS NOT NULL THEN list_transform(string_split(b, chr(10)), lambda s, i: CASE WHEN {blank_sql('s')} THEN NULL WHEN {_HEADER} THEN chr(10) || s || chr(10)
        WHEN i = 1 THEN '<span class="translated">' || s || '</span>' ELSE '      ' || s END) ELSE [] END,
    CASE WHEN a IS NOT NULL THEN ['<span class="original">' || {strip_sql('a')} || '</span>'] ELSE [] END,
    CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN ['<hr class="bilingual-separator">'] ELSE [] END), lambda x: x IS NOT NULL), chr(10)) || chr(10) AS block FROM blocks)
SELECT p.row_id, md5(coalesce(string_agg(block, '' ORDER BY k), '')) AS md5 FROM p LEFT JOIN parts USING (row_id) GROUP BY p.row_id"""


def rendered_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every part of every book's rendering, its head included."""
    rows = status.latest_segments(read(spark, d, "segments"))
    heads = read(spark, d, "books").select("doc_id", F.col("file_name").alias("title"), F.upper("file_name").alias("translated_title"))
    parts = sinks.markdown_parts(rows, heads, use_breadcrumb=True)
    return parts.select("doc_id", "part", F.md5("markdown").alias("md5"))


RENDERED_DOCUMENTS = f"""WITH {LATEST}, parts AS (
    SELECT doc_id, segment_id AS part, markdown FROM ({_markdown_sql('latest', True)})
    UNION ALL SELECT doc_id, -1, '# ' || upper(file_name) || ' - ' || file_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) FROM books
) SELECT doc_id, part, md5(markdown) AS md5 FROM parts"""


def page_marks(spark: SparkSession, d: str) -> DataFrame:
    """Pages marked in the rendering of each row, and the rendering with marks taken out."""
    rows = R.render_segments(read(spark, d, "segments"), use_breadcrumb=False)
    return rows.select("row_id", R.page_numbers("markdown").alias("pages"), F.char_length(R.without_marks("markdown")).alias("n_chars")).select("row_id", F.size("pages").alias("n_pages"), F.get("pages", F.lit(0)).alias("page"), "n_chars")


_MARK = "\\n*#{6}\\s*---\\s*原文第\\s*(\\d+)\\s*页\\s*---\\s*\\n*"
PAGE_MARKS = f"""SELECT row_id, CAST(len(pages) AS INT) AS n_pages, CAST(pages[1] AS INT) AS page,
    CAST(length(regexp_replace(regexp_replace(regexp_replace(markdown, '{_MARK}', chr(10) || chr(10) || '<!-- PAGE_MARKER_0 -->' || chr(10) || chr(10), 'g'), '🔖\\s*\\*\\*Segment\\s+\\d+\\*\\*(?: \\(Image\\))?.*', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS INT) AS n_chars
FROM (SELECT *, regexp_extract_all(markdown, '{_MARK}', 1) AS pages FROM ({_markdown_sql('segments', False)}))"""
PAGE_MARKS_FOUND = f"""SELECT row_id, CAST(CASE WHEN marked THEN 1 ELSE 0 END AS INT) AS n_pages, CASE WHEN marked THEN page_index + 1 END AS page FROM (
    SELECT *, content_type <> 'image' AND page_index IS NOT NULL AND NOT coalesce(is_new_chapter, false) AS marked FROM segments)"""


def page_marks_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages marked in the rendering of each row."""
    return page_marks(spark, d).drop("n_chars")


def markdown_inline_html(spark: SparkSession, d: str) -> DataFrame:
    """Inline Markdown of documents as tags: how many of each kind."""
    rows = read(spark, d, "documents").where("text is not null").select("doc_id", T.inline_markdown_to_html("text").alias("h"))
    return rows.select("doc_id", *[F.size(F.regexp_extract_all("h", F.lit(f"<{t}[ >]"), F.lit(0))).alias(f"n_{t}") for t in ("a", "code", "del", "strong")])


_INLINE = "text"
for _pattern, _to in T.INLINE_MARKDOWN[:5]:
    _INLINE = f"regexp_replace({_INLINE}, '{_pattern}', '{_to.replace('$', chr(92))}', 'g')"
MARKDOWN_INLINE_HTML = "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(h, '<{t}[ >]')) AS INT) AS n_{t}" for t in ("a", "code", "del", "strong")) + f" FROM (SELECT doc_id, {_INLINE} AS h FROM documents WHERE text IS NOT NULL)"


def markdown_emphasis(spark: SparkSession, d: str) -> DataFrame:
    """Emphasised passages of documents (its patterns look around, which SQL's don't)."""
    rows = read(spark, d, "documents").where("text is not null").select("doc_id", T.inline_markdown_to_html("text").alias("h"))
    return rows.select("doc_id", F.size(F.regexp_extract_all("h", F.lit("<em[ >]"), F.lit(0))).alias("n_em"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of HTML: documents that are marked up, and the rest in paragraphs."""
    text = F.coalesce("text", F.lit(""))
    made = F.concat(F.lit("<html><head><style>p {}</style></head><body>"), F.array_join(F.transform(T.paragraphs(text), lambda p: F.concat(F.lit("<p>"), T.escape_html(p), F.lit("</p>"))), "\n"), F.lit("</body></html>"))
    return read(spark, d, "documents").select("doc_id", F.when(text.rlike("</(p|h[1-6]|li)>"), text).otherwise(made).alias("html"))


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of HTML pages with their tags and texts."""
    return H.explode_blocks(_pages(spark, d), "doc_id").select("doc_id", "pos", "tag", F.md5("text").alias("md5"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of HTML pages."""
    return _pages(spark, d).select("doc_id", F.md5(H.extract_text("html")).alias("md5"))


def html_chapters(spark: SparkSession, d: str) -> DataFrame:
    """HTML pages cut into chapters at their headings."""
    each = _pages(spark, d).select("doc_id", F.posexplode(R.chapters_of(R.body_of("html"))).alias("chapter_no", "c"))
    return each.select("doc_id", "chapter_no", F.col("c.title").alias("title"), F.md5("c.html").alias("md5"))


def html_refilled(spark: SparkSession, d: str) -> DataFrame:
    """HTML pages with their blocks replaced by translations found by text (here: upper case)."""
    pages = _pages(spark, d)
    entries = H.explode_blocks(pages, "doc_id").select("doc_id", "text", F.upper("text").alias("translation"))
    return H.refill(pages, entries, "doc_id").select("doc_id", F.md5("html").alias("md5"), "replaced")


def stub_translate_e2e(spark: SparkSession, d: str) -> DataFrame:
    """Current segments through requests, a stub backend, parsing and joining back."""
    rows = status.latest_segments(read(spark, d, "segments"))
    out = translate.translate(rows, translate.Identity(), 5)
    return out.select("doc_id", "segment_id", F.md5("translated_text").alias("md5"), "route")


STUB_TRANSLATE_E2E = f"WITH {LATEST} SELECT doc_id, segment_id, md5(CASE WHEN coalesce(original_text, '') = '' THEN '{T.EMPTY_RESPONSE}' ELSE original_text END) AS md5, 'strict' AS route FROM latest"


def stub_faulty_e2e(spark: SparkSession, d: str) -> DataFrame:
    """The same with a backend that makes the mistakes of real ones: how replies were read."""
    rows = status.latest_segments(read(spark, d, "segments"))
    out = translate.translate(rows, translate.Faulty(), 5)
    return out.groupBy("route").agg(F.count("*").alias("n_segments"), F.count_if(T.is_success("translated_text")).alias("n_success"))


def two_phase_e2e(spark: SparkSession, d: str) -> DataFrame:
    """The run in two phases: preamble, glossary from it, everything with the glossary."""
    rows = status.latest_segments(read(spark, d, "segments"))

    def extract(done: DataFrame) -> DataFrame:
        """Terms: words of the titles met, translated by the backend's rule."""
        words = done.select(F.explode(F.split(F.coalesce("chapter_title", F.lit("")), " ")).alias("term")).distinct()
        return words.select(F.lit(0).alias("batch_id"), (F.crc32("term") % 1000000).cast("int").alias("ord"), "term", F.upper("term").alias("translation"))

    out = translate.two_phase(rows, translate.Upper(), extract)
    return out.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.count_if(T.is_success("translated_text")).alias("n_success"))


TWO_PHASE_E2E = f"WITH {LATEST} SELECT doc_id, count(*) AS n_segments, count_if(coalesce(original_text, '') <> '') AS n_success FROM latest GROUP BY doc_id"


def request_items(spark: SparkSession, d: str) -> DataFrame:
    """Requests: ids, context and size of every batch."""
    rows = status.latest_segments(read(spark, d, "segments"))
    merged = glossary.merged(read(spark, d, "glossary_batch"))
    out = translate.requests(rows, 5, merged)
    return out.select("doc_id", "batch_id", "vision", F.array_join(F.transform("expected_ids", lambda x: x.cast("string")), ",").alias("ids"), F.md5("context").alias("context_md5"), F.char_length("glossary_text").alias("glossary_chars"))


REQUEST_ITEMS = f"""WITH {LATEST}, before AS (
    SELECT *, coalesce(lag(original_text) OVER (PARTITION BY doc_id ORDER BY segment_id, row_id), '') AS c,
        CAST((row_number() OVER (PARTITION BY doc_id ORDER BY segment_id, row_id) - 1) // 5 + 1 AS BIGINT) AS batch_id FROM latest
), terms AS (
    SELECT {strip_sql('term')} AS term, {strip_sql('translation')} AS translation, batch_id, ord FROM glossary_batch WHERE NOT {blank_sql('term')} AND NOT {blank_sql('translation')}
), lines AS (SELECT term, arg_max(translation, (batch_id, ord, translation)) AS translation FROM terms GROUP BY term
), whole AS (SELECT CAST(sum(length('- **' || term || '**: ' || translation)) + count(*) - 1 AS INT) AS n FROM lines)
SELECT doc_id, batch_id, bool_or(content_type = 'image') AS vision, string_agg(segment_id, ',' ORDER BY segment_id) AS ids,
    md5(arg_min({strip_sql(f"right({strip_sql('c')}, 500)")}, segment_id)) AS context_md5, (SELECT n FROM whole) AS glossary_chars FROM before GROUP BY doc_id, batch_id"""

PROMPTS = f"""WITH {LATEST}, before AS (
    SELECT *, coalesce(lag(original_text) OVER (PARTITION BY doc_id ORDER BY segment_id, row_id), '') AS c,
        CAST((row_number() OVER (PARTITION BY doc_id ORDER BY segment_id, row_id) - 1) // 5 + 1 AS BIGINT) AS batch_id FROM latest
), terms AS (
    SELECT {strip_sql('term')} AS term, {strip_sql('translation')} AS translation, batch_id, ord FROM glossary_batch WHERE NOT {blank_sql('term')} AND NOT {blank_sql('translation')}
), lines AS (SELECT term, arg_max(translation, (batch_id, ord, translation)) AS translation FROM terms GROUP BY term
), whole AS (SELECT sum(length('- **' || term || '**: ' || translation)) + count(*) - 1 AS n FROM lines
), asked AS (
    SELECT doc_id, batch_id, arg_min({strip_sql(f"right({strip_sql('c')}, 500)")}, segment_id) AS context,
        CAST(to_json(list({{'id': segment_id, 'text': coalesce(original_text, '')}} ORDER BY segment_id)) AS VARCHAR) AS items FROM before GROUP BY doc_id, batch_id)
SELECT doc_id, batch_id, CAST(length('What comes before:') + 1 + CASE WHEN {blank_sql('context')} THEN {len(P.BEGINNING)} ELSE length(context) END + 2
    + length('Use these translations:') + 1 + (SELECT n FROM whole) + 2 + length('Passages:') + 1 + length(items) AS INT) AS n_chars FROM asked"""

QUERIES = {
    f.__name__: f
    for f in (
        response_parse, response_routes, glossary_reply_entries, glossary_shapes, prompts, system_instructions, text_scalars, clean_text, markdown_render, bilingual_paragraphs, rendered_documents, page_marks,
        page_marks_found, markdown_inline_html, markdown_emphasis, html_blocks, html_text, html_chapters, html_refilled, stub_translate_e2e, stub_faulty_e2e, two_phase_e2e, request_items,
    )
}
SQL = {
    "response_parse": RESPONSE_PARSE, "response_routes": RESPONSE_ROUTES, "glossary_reply_entries": GLOSSARY_REPLY_ENTRIES, "glossary_shapes": GLOSSARY_SHAPES, "system_instructions": SYSTEM_INSTRUCTIONS, "text_scalars": TEXT_SCALARS, "clean_text": CLEAN_TEXT,
    "rendered_documents": RENDERED_DOCUMENTS, "stub_translate_e2e": STUB_TRANSLATE_E2E, "request_items": REQUEST_ITEMS, "two_phase_e2e": TWO_PHASE_E2E, "markdown_inline_html": MARKDOWN_INLINE_HTML,
    "markdown_render": MARKDOWN_RENDER, "bilingual_paragraphs": BILINGUAL_PARAGRAPHS, "page_marks": PAGE_MARKS, "page_marks_found": PAGE_MARKS_FOUND, "prompts": PROMPTS,
}
