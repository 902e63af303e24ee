"""Queries on contents from files, page pictures, catalogues of models, and parts of rendered HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoflow.functions import render as R
from versoflow.functions import text as T
from versoflow.operators import models, status, titles, toc
from versoflow.plans.common import LATEST, blank_sql, read, strip_sql
from versoflow.sources import pages


def _csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """Contents as rows of a CSV file: padded, some without a page or level, some with a page that is no number."""
    items = read(spark, d, "toc_items")
    page = F.when((F.col("doc_id") % 5 == 0) & (F.col("ord") == 1), "x").when(F.col("ord") % 7 == 3, None).otherwise(F.concat(F.lit(" "), F.col("ord").cast("string"), F.lit(" ")))
    level = F.when(F.col("ord") % 4 == 2, "").otherwise(F.col("level").cast("string"))
    return items.select("doc_id", "ord", page.alias("page"), "title", level.alias("level"))


def toc_csv_items(spark: SparkSession, d: str) -> DataFrame:
    """Contents read from CSV rows."""
    return toc.csv_items(_csv_rows(spark, d))


_CSV = f"""csv AS (
    SELECT doc_id, ord, CASE WHEN ord % 4 = 2 OR level IS NULL THEN 1 ELSE level END AS level,
        CASE WHEN {blank_sql('title')} THEN 'Page ' || ord ELSE {strip_sql('title')} END AS title, CAST(ord - 1 AS VARCHAR) AS key
    FROM toc_items WHERE NOT (ord % 7 = 3 AND NOT (doc_id % 5 = 0 AND ord = 1)) AND ord >= 1
        AND doc_id NOT IN (SELECT doc_id FROM toc_items WHERE doc_id % 5 = 0 AND ord = 1)
)"""
TOC_CSV_ITEMS = f"WITH {_CSV} SELECT doc_id, ord, level, title, key FROM csv"


def toc_first_source(spark: SparkSession, d: str) -> DataFrame:
    """Contents of each book from its CSV rows or, where these give none, from the book itself."""
    return toc.first_source(toc.csv_items(_csv_rows(spark, d)), read(spark, d, "toc_items"))


TOC_FIRST_SOURCE = f"""WITH {_CSV} SELECT doc_id, ord, level, title, key FROM csv
UNION ALL SELECT doc_id, ord, level, title, key FROM toc_items WHERE doc_id NOT IN (SELECT doc_id FROM csv)"""


def page_image_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the pictures of image rows, but for those that a row has already."""
    rows = read(spark, d, "segments").where("content_type = 'image' and page_index is not null")
    have = rows.where("image_path is not null").select(F.col("image_path").alias("path")).distinct()
    return pages.page_images(rows.select("row_id", "doc_id", "page_index"), "images/", have).select("row_id", "image_path")


PAGE_IMAGE_PATHS = """WITH rows AS (
    SELECT row_id, 'images/' || doc_id || '_page_' || lpad(CAST(page_index + 1 AS VARCHAR), CAST(greatest(4, length(CAST(page_index + 1 AS VARCHAR))) AS INT), '0') || '.jpg' AS image_path FROM segments WHERE content_type = 'image' AND page_index IS NOT NULL)
SELECT row_id, image_path FROM rows WHERE image_path NOT IN (SELECT image_path FROM segments WHERE content_type = 'image' AND page_index IS NOT NULL AND image_path IS NOT NULL)"""


def _models(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue of models made from the books: names by service and mode, every third not for generating."""
    b = read(spark, d, "books").groupBy("service", "mode_id").agg(F.min("doc_id").alias("n"))
    name = F.concat_ws("-", "service", F.when(F.col("n") % 4 == 0, "flash").when(F.col("n") % 4 == 1, "vision").when(F.col("n") % 4 == 2, "aqa"), "mode_id", F.col("n").cast("string"))
    methods = F.when(F.col("n") % 3 == 0, F.array(F.lit("embedContent"))).otherwise(F.array(F.lit(models.GENERATES), F.lit("countTokens")))
    return b.select(name.alias("name"), methods.alias("methods"), F.when(F.col("n") % 5 != 0, F.col("n") * 12345).alias("input_token_limit"), (F.col("n") * 100).alias("output_token_limit"))


def models_listing(spark: SparkSession, d: str) -> DataFrame:
    """Usable models with their inputs, features and limits."""
    return models.listing(_models(spark, d))


MODELS_LISTING = f"""WITH m AS (
    SELECT concat_ws('-', service, CASE n % 4 WHEN 0 THEN 'flash' WHEN 1 THEN 'vision' WHEN 2 THEN 'aqa' END, mode_id, CAST(n AS VARCHAR)) AS name, n
    FROM (SELECT service, mode_id, min(doc_id) AS n FROM books GROUP BY service, mode_id) WHERE n % 3 <> 0
), k AS (SELECT *, contains(name, 'gemini') AND (contains(name, 'vision') OR contains(name, '1.5') OR contains(name, '2.5') OR contains(name, 'flash')) AS multi FROM m)
SELECT name, CASE WHEN multi THEN '{models.ALL_INPUTS}' WHEN contains(name, 'vision') THEN '{models.IMAGE_INPUT}' ELSE '{models.TEXT_INPUT}' END AS inputs,
    coalesce(nullif(concat_ws(', ', CASE WHEN multi THEN '{models.LARGE_CONTEXT}' END, CASE WHEN contains(name, 'aqa') THEN '{models.GROUNDED}' END), ''), '{models.STANDARD}') AS features,
    CASE WHEN n % 5 <> 0 THEN format('{{:,}}', n * 12345) ELSE 'N/A' END AS input_limit, format('{{:,}}', n * 100) AS output_limit FROM k"""


def html_content_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every row as a paragraph of HTML, wrapped with its page and chapter."""
    p = F.concat(F.lit("<p>"), T.escape_html(F.coalesce("original_text", F.lit(""))), F.lit("</p>"))
    return read(spark, d, "segments").select("row_id", F.md5(R.content_block(p, F.col("page_index"), "chapter_title")).alias("md5"))


def _escaped_sql(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


HTML_CONTENT_BLOCKS = f"""SELECT row_id, md5('<div class="content-block"><div class="chapter-title" style="string-set: chapter content(); display:none;">' || {_escaped_sql("coalesce(chapter_title, '')")} || '</div><span class="decor" aria-hidden="true"></span>'
    || coalesce('<span class="page-marker">P' || (page_index + 1) || '</span>', '') || '<p>' || {_escaped_sql("coalesce(original_text, '')")} || '</p></div>') AS md5 FROM segments"""


def html_heading_spacing(spark: SparkSession, d: str) -> DataFrame:
    """Contents titles as headings of HTML with their levels and spaces."""
    n = F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce("level", F.lit(1)))).cast("string")
    html = F.concat(F.lit("<h"), n, F.when(F.col("ord") % 2 == 0, ' class="c"').otherwise(""), F.lit(">"), T.escape_html(F.coalesce("title", F.lit(""))), F.lit("</h"), n, F.lit(">"))
    return read(spark, d, "toc_items").select("doc_id", "ord", R.heading_spacing(html).alias("html"))


_HEADING = f"""'<h' || n || CASE WHEN ord % 2 = 0 THEN ' class="c"' ELSE '' END || '>' || {_escaped_sql("coalesce(title, '')")} || '</h' || n || '>'"""
for _level, _space in R.HEADING_SPACE.items():
    _HEADING = f"""regexp_replace({_HEADING}, '<h{_level}(\\s[^>]*)?>', '<h{_level} data-toc-level="{_level}" style="margin-top: {_space:.2f}em;"\\1>', 'g')"""
HTML_HEADING_SPACING = f"SELECT doc_id, ord, {_HEADING} AS html FROM (SELECT *, least(6, greatest(1, coalesce(level, 1))) AS n FROM toc_items)"


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """A whole HTML page of every current row, its titles in head and header."""
    rows = status.latest_segments(read(spark, d, "segments"), ["row_id", "original_text", "chapter_title", "loaded_at"])
    page = R.html_page(F.coalesce("original_text", F.lit("")), F.coalesce("chapter_title", F.lit("")), F.lit("O & P"), "p {}")
    return rows.select("doc_id", "segment_id", F.md5(page).alias("md5"), F.md5(R.body_of(page)).alias("body_md5"), R.styles_of(page).alias("css"))


_HEAD = f"{_escaped_sql(chr(116))} || ' - ' || 'O &amp; P'"
HTML_PAGES = f"""WITH {LATEST}, made AS (SELECT doc_id, segment_id, {_HEAD} AS head, coalesce(original_text, '') AS body FROM (SELECT *, coalesce(chapter_title, '') AS t FROM latest))
SELECT doc_id, segment_id, md5('<!DOCTYPE html><html><head><meta charset="utf-8"/><title>' || head || '</title><style>p {{}}</style></head><body><header>' || head || '</header>' || body || '</body></html>') AS md5,
    md5('<header>' || head || '</header>' || CASE WHEN contains(lower(body), '</body>') THEN regexp_extract(body, '(?is)^(.*?)</body>', 1) ELSE body END) AS body_md5, 'p {{}}' AS css FROM made"""


def image_data_urls(spark: SparkSession, d: str) -> DataFrame:
    """Data URLs of pictures (here: of their rows' keys), their type by the path's extension."""
    rows = read(spark, d, "segments").where("image_path is not null")
    return rows.select("row_id", T.data_url("image_path", F.encode(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("segment_id").cast("string")), "utf-8")).alias("url"))


IMAGE_DATA_URLS = """SELECT row_id, 'data:' || CASE list_extract(string_split(image_path, '.'), -1) WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif' WHEN 'webp' THEN 'image/webp' WHEN 'svg' THEN 'image/svg+xml' ELSE 'image/jpeg' END
    || ';base64,' || base64(encode(concat_ws('/', CAST(doc_id AS VARCHAR), CAST(segment_id AS VARCHAR)))) AS url FROM segments WHERE image_path IS NOT NULL"""


def titles_with_documents(spark: SparkSession, d: str) -> DataFrame:
    """Titles to translate, the books' own before their chapters'."""
    books = read(spark, d, "books").select("doc_id", F.col("file_name").alias("title"))
    return titles.candidates(read(spark, d, "segments"), books)


TITLES_WITH_DOCUMENTS = f"""SELECT doc_id, title, min(place) AS first_segment, count_if(place >= 0) AS n_chapters FROM (
    SELECT doc_id, chapter_title AS title, segment_id AS place FROM segments WHERE coalesce(is_new_chapter, false)
    UNION ALL SELECT doc_id, file_name, -1 FROM books
) WHERE NOT {blank_sql('title')} AND NOT coalesce(regexp_matches(title, '[\\x{{4e00}}-\\x{{9fff}}]'), false) GROUP BY doc_id, title"""

QUERIES = {
    f.__name__: f
    for f in (toc_csv_items, toc_first_source, page_image_paths, models_listing, html_content_blocks, html_heading_spacing, html_pages, image_data_urls, titles_with_documents)
}
SQL = {
    "toc_csv_items": TOC_CSV_ITEMS, "toc_first_source": TOC_FIRST_SOURCE, "page_image_paths": PAGE_IMAGE_PATHS, "models_listing": MODELS_LISTING, "html_content_blocks": HTML_CONTENT_BLOCKS,
    "html_heading_spacing": HTML_HEADING_SPACING, "html_pages": HTML_PAGES, "image_data_urls": IMAGE_DATA_URLS, "titles_with_documents": TITLES_WITH_DOCUMENTS,
}
