"""Rendering segments as Markdown, and the HTML steps behind it. Column expressions but for the chapter split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versoflow.functions.text import _c, escape_html, is_blank, is_heading_line, paragraphs, strip

# Signs before headings by level, the signs of the two other modes, and the pieces of the Markdown.
LEVEL_SIGNS = {1: "📚", 2: "📖", 3: "📄", 4: "📝", 5: "📌"}
PATH_SIGN, PAGE_SIGN = "🧭", "🔖"
RULE = "\n\n---"
# Space above headings h2 to h5, in em.
HEADING_SPACE = {2: 0.20, 3: 0.15, 4: 0.10, 5: 0.05}
DEFAULT_CHAPTER, WHOLE = "前言", "全文"


def clean_text(x: Column | str) -> Column:
    """Text made safe for layout: no carriage returns, written-out line ends undone, indents as no-break spaces (half
    as many and one), wide spaces as plain ones, runs of blanks as two, three and more line ends as two, stripped.
    Null gives the empty text.
    """
    t = F.replace(F.replace(F.coalesce(_c(x), F.lit("")), F.lit("\r"), F.lit("")), F.lit("\\n"), F.lit("\n"))

    def line(s: Column) -> Column:
        body = F.regexp_replace(s, "^[ \t　]+", "")
        n = F.char_length(s) - F.char_length(body)
        indent = F.when(n > 0, F.repeat(F.lit(" "), (F.floor(n / 2) + 1).cast("int"))).otherwise("")
        return F.regexp_replace(F.replace(F.concat(indent, body), F.lit("　"), F.lit(" ")), "[ \t]{2,}", "  ")

    joined = F.array_join(F.transform(F.split(t, "\n"), line), "\n")
    return strip(F.regexp_replace(joined, "\n{3,}", "\n\n"))


def title_mode(segments: DataFrame, use_breadcrumb: bool) -> DataFrame:
    """doc_id, mode: ``breadcrumb`` if so set, ``page_only`` for documents without any chapter, else ``normal``."""
    has = F.bool_or(F.coalesce("is_new_chapter", F.lit(False)) & (F.coalesce("chapter_title", F.lit("")) != ""))
    mode = F.lit("breadcrumb") if use_breadcrumb else F.when(has, "normal").otherwise("page_only")
    return segments.groupBy("doc_id").agg(F.first(mode).alias("mode") if use_breadcrumb else mode.alias("mode"))


def heading_sign(level: Column, mode: Column) -> Column:
    signs = F.create_map(*[F.lit(x) for pair in LEVEL_SIGNS.items() for x in pair])
    return F.when(mode == "breadcrumb", PATH_SIGN).when(mode == "page_only", PAGE_SIGN).otherwise(F.coalesce(F.try_element_at(signs, level), F.lit("📄")))


def structure(mode: Column, page_markers: bool = True) -> Column:
    """The heading of a segment that opens a chapter, else its page mark (pages from 1), else nothing."""
    fresh = F.coalesce(F.col("is_new_chapter"), F.lit(False))
    level = F.greatest(F.lit(1), F.least(F.coalesce(F.nullif(F.col("toc_level"), F.lit(0)), F.lit(1)), F.lit(5)))
    heading = F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), level + 1), F.lit(" "), heading_sign(level, mode), F.lit(" "), clean_text("chapter_title"), F.lit("\n\n"))
    page = F.concat(F.lit("\n\n###### --- 原文第 "), (F.col("page_index") + 1).cast("string"), F.lit(" 页 --- \n\n"))
    opened = fresh & (F.coalesce(F.col("chapter_title"), F.lit("")) != "")
    marked = F.when(F.col("page_index").isNotNull() & ~fresh, page).otherwise("") if page_markers else F.lit("")
    return F.when(opened, heading).otherwise(marked)


def translation_only(text: Column | str) -> Column:
    """The cleaned translation line by line; heading lines stand free, blank lines are empty."""
    lines = F.split(clean_text(text), "\n")
    return F.array_join(F.transform(lines, lambda s: F.when(is_blank(s), "").when(is_heading_line(s), F.concat(F.lit("\n"), s, F.lit("\n"))).otherwise(s)), "\n")


def bilingual(original: Column | str, translated: Column | str) -> Column:
    """Paragraphs of translation and original side by side by place, a rule behind those that have both."""
    o, t = paragraphs(clean_text(original)), paragraphs(clean_text(translated))
    def lines(p: Column) -> Column:
        each = F.transform(F.split(p, "\n"), lambda s, j: F.when(is_blank(s), None).when(is_heading_line(s), F.concat(F.lit("\n"), s, F.lit("\n"))).when(
            j == 0, F.concat(F.lit('<span class="translated">'), s, F.lit("</span>"))).otherwise(F.concat(F.lit("      "), s)))
        return F.filter(each, lambda s: s.isNotNull())

    def block(b: Column, a: Column) -> Column:
        none = F.array().cast("array<string>")
        parts = F.concat(
            F.when(a.isNotNull(), lines(F.coalesce(a, F.lit("")))).otherwise(none),
            F.when(b.isNotNull(), F.array(F.concat(F.lit('<span class="original">'), strip(b), F.lit("</span>")))).otherwise(none),
            F.when(a.isNotNull() & b.isNotNull(), F.array(F.lit('<hr class="bilingual-separator">'))).otherwise(none),
        )
        return F.concat(F.array_join(parts, "\n"), F.lit("\n"))

    # the shorter side is padded with nulls; both lists are computed once, not once a paragraph
    return F.array_join(F.zip_with(o, t, block), "")


def image_block() -> Column:
    """The picture of an image segment with its caption; a rule behind it. Without a path only the rule."""
    picture = F.concat(F.lit("\n\n![Segment "), F.col("segment_id").cast("string"), F.lit("]("), F.col("image_path"), F.lit(")"))
    caption = F.when(~is_blank("translated_text"), F.concat(F.lit("\n> 💡 **图注/内容译文**\n> "), clean_text("translated_text"))).otherwise("")
    return F.concat(F.when(F.coalesce(F.col("image_path"), F.lit("")) != "", F.concat(picture, caption)).otherwise(""), F.lit("\n"), F.lit(RULE))


def render_segments(segments: DataFrame, use_breadcrumb: bool = True, retain_original: bool = False, page_markers: bool = True) -> DataFrame:
    """Segments with ``markdown``. The mode is one small row a document, joined, not collected."""
    mode = title_mode(segments, use_breadcrumb)
    content = bilingual("original_text", "translated_text") if retain_original else translation_only("translated_text")
    text = F.concat(structure(F.col("mode"), page_markers), content, F.lit(RULE))
    return segments.join(mode, "doc_id").withColumn("markdown", F.when(F.col("content_type") == "image", image_block()).otherwise(text)).drop("mode")


def document_head(translated_title: Column | str, original_title: Column | str) -> Column:
    return F.concat(F.lit("# "), _c(translated_title), F.lit(" - "), _c(original_title), F.lit("\n\n---\n\n"))


def page_numbers(markdown: Column | str) -> Column:
    """Page numbers marked in rendered Markdown, in order."""
    return F.transform(F.regexp_extract_all(_c(markdown), F.lit(r"\n*#{6}\s*---\s*原文第\s*(\d+)\s*页\s*---\s*\n*"), F.lit(1)), lambda s: s.cast("int"))


def without_marks(markdown: Column | str) -> Column:
    """Rendered Markdown with page marks as numbered comments and segment marks removed, line ends squeezed."""
    parts = F.split(_c(markdown), r"\n*#{6}\s*---\s*原文第\s*\d+\s*页\s*---\s*\n*")
    numbered = F.transform(parts, lambda s, k: F.when(k == 0, s).otherwise(F.concat(F.lit("\n\n<!-- PAGE_MARKER_"), (k - 1).cast("string"), F.lit(" -->\n\n"), s)))
    clean = F.regexp_replace(F.array_join(numbered, ""), r"🔖\s*\*\*Segment\s+\d+\*\*(?: \(Image\))?.*", "")
    return F.regexp_replace(clean, "\n{3,}", "\n\n")


def content_block(html: Column | str, page: Column, chapter: Column | str, page_markers: bool = True) -> Column:
    """A part of HTML with paragraphs, wrapped with its page and chapter; other parts stay."""
    mark = F.coalesce(F.concat(F.lit('<span class="page-marker">P'), (page + 1).cast("string"), F.lit("</span>")), F.lit("")) if page_markers else F.lit("")
    title = F.concat(F.lit('<div class="chapter-title" style="string-set: chapter content(); display:none;">'), escape_html(F.coalesce(_c(chapter), F.lit(""))), F.lit("</div>"))
    wrapped = F.concat(F.lit('<div class="content-block">'), title, F.lit('<span class="decor" aria-hidden="true"></span>'), mark, _c(html), F.lit("</div>"))
    return F.when(_c(html).rlike(r"(?s)<p[^>]*>.*?</p>"), wrapped).otherwise(_c(html))


def heading_spacing(html: Column | str) -> Column:
    """Headings h2 to h5 with their level and the space above them; those that have it stay."""
    out = _c(html)
    for level, space in HEADING_SPACE.items():
        out = F.regexp_replace(out, rf"<h{level}(?![^>]*data-toc-spacing)(\s[^>]*)?>", f'<h{level} data-toc-level="{level}" style="margin-top: {space:.2f}em;"$1>')
    return out


def body_of(html: Column | str) -> Column:
    inner = r"(?is)<body[^>]*>(.*?)</body>"
    return F.when(_c(html).rlike(inner), F.regexp_extract(_c(html), inner, 1)).otherwise(_c(html))


def styles_of(html: Column | str) -> Column:
    return F.array_join(F.regexp_extract_all(_c(html), F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1)), "\n\n")


def chapters_of(html: Column | str) -> Column:
    """Array of (title, html): cut before each h2 to h5; titles without tags and signs, with defaults for none.

    Blank parts are left out; a text without headings is one chapter.
    """
    heading = r"(?is)<h[2-5][^>]*>.*?</h[2-5]>"
    parts = F.filter(F.split(_c(html), r"(?i)(?=<h[2-5][^>]*>)"), lambda p: ~is_blank(p))

    def title(p: Column, k: Column) -> Column:
        text = strip(F.regexp_replace(F.regexp_replace(F.regexp_extract(p, heading, 0), "(?s)<.*?>", ""), "[📚📖📄📝📌🧭🔖]", ""))
        return F.when(~p.rlike("^(?i)<h[2-5]"), DEFAULT_CHAPTER).when(text == "", F.concat(F.lit("章节 "), (k + 1).cast("string"))).otherwise(text)

    found = F.transform(parts, lambda p, k: F.struct(title(p, k).alias("title"), p.alias("html")))
    return F.when(F.size(parts) > 0, found).otherwise(F.array(F.struct(F.lit(WHOLE).alias("title"), _c(html).alias("html"))))


def html_page(body: Column | str, translated_title: Column | str, original_title: Column | str, css: str = "") -> Column:
    """A whole HTML page: titles in its head and above its body."""
    head = F.concat(escape_html(translated_title), F.lit(" - "), escape_html(original_title))
    return F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"/><title>'), head, F.lit("</title><style>" + css + "</style></head><body><header>"), head, F.lit("</header>"), _c(body), F.lit("</body></html>")
    )


def wrapped_parts(html: Column | str, pages: Column, chapters: Column, page_markers: bool = True) -> Column:
    """HTML cut at its rules, each part with paragraphs wrapped with the page and chapter of its place among them.

    ``pages`` and ``chapters`` are arrays, one entry a part with paragraphs; parts without entries get none.
    """
    rule = r"<hr\s*/?>"
    parts, rules = F.split(_c(html), rule), F.regexp_extract_all(_c(html), F.lit(rule), F.lit(0))
    holds = lambda p: p.rlike(r"(?s)<p[^>]*>.*?</p>")
    start = F.named_struct(F.lit("n"), F.lit(0), F.lit("out"), F.array().cast("array<string>"))

    def step(acc: Column, p: Column) -> Column:
        mine = content_block(p, F.get(pages, acc["n"]), F.get(chapters, acc["n"]), page_markers)
        return F.named_struct(F.lit("n"), acc["n"] + holds(p).cast("int"), F.lit("out"), F.concat(acc["out"], F.array(mine)))

    wrapped = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.array_join(F.zip_with(wrapped, rules, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
