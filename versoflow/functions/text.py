"""Scalar functions on text columns, all inside the JVM.

White space means Unicode white space throughout, as ``str.strip`` has it. Null gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a class of a Java regular expression.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
#: Fixed value: the failure marker that the data model knows, and those that the processing loops know.
NOT_TRANSLATED = "[Translation Failed"
FAILED_HEAD, FAILED_TAIL, BLOCKED_HEAD = "[Failed", "Failed]", "[Failed: Blocked"
EMPTY_RESPONSE, MISSING_TRANSLATION, MISSING_IN_RESPONSE, PARSE_ERROR = (
    "[Failed: Empty response]", "[Failed: Missing translation]", "[Failed: Missing in response]", "[Failed: JSON Parse Error]",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_c(x), f"^{SPACE}+|{SPACE}+$", "")


def is_blank(x: Column | str) -> Column:
    """True for null, empty and all-white-space text; never null."""
    return _c(x).isNull() | ~F.coalesce(_c(x).rlike(rf"[^\t-\r\x1c-\x20\x85\p{{Z}}]"), F.lit(False))


def normalize(x: Column | str) -> Column:
    """Stripped, with every run of white space as one space."""
    return F.regexp_replace(strip(x), f"{SPACE}+", " ")


def clean_lines(x: Column | str) -> Column:
    """Stripped non-blank lines, joined by blank lines."""
    lines = F.transform(F.split(_c(x), "\n"), strip)
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n\n")


def paragraphs(x: Column | str) -> Column:
    """The parts between blank lines that aren't blank; null and empty text have none."""
    return F.filter(F.split(F.coalesce(_c(x), F.lit("")), "\n\n"), lambda p: ~is_blank(p))


def has_chinese(x: Column | str) -> Column:
    return _c(x).rlike("[\\u4e00-\\u9fff]")


def has_cjk(x: Column | str) -> Column:
    return _c(x).rlike("[\\u3040-\\u30ff\\u4e00-\\u9fff]")


def is_heading_line(x: Column | str) -> Column:
    return F.startswith(strip(x), F.lit("#"))


def is_translated(x: Column | str) -> Column:
    """The data model's view: not blank, and without the marker of a failed translation. Never null."""
    return ~is_blank(x) & ~F.contains(F.coalesce(_c(x), F.lit("")), F.lit(NOT_TRANSLATED))


def is_success(x: Column | str) -> Column:
    """The loops' view: not empty, and neither begun nor ended by a failure marker. Never null."""
    t = F.coalesce(_c(x), F.lit(""))
    return (t != "") & ~F.startswith(t, F.lit(FAILED_HEAD)) & ~F.endswith(t, F.lit(FAILED_TAIL))


def is_blocked(x: Column | str) -> Column:
    return F.startswith(F.coalesce(_c(x), F.lit("")), F.lit(BLOCKED_HEAD))


def or_empty_marker(x: Column | str) -> Column:
    """The text, or the marker of an empty response."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(EMPTY_RESPONSE))


def tail(x: Column | str, n: int) -> Column:
    return F.right(_c(x), F.lit(n)) if n > 0 else F.lit("")


def abridged(x: Column | str, n: int = 1000) -> Column:
    """At most n characters, an ellipsis of three dots behind what was shortened."""
    return F.when(F.char_length(_c(x)) > n, F.concat(F.left(_c(x), F.lit(n)), F.lit("..."))).otherwise(_c(x))


def clean_filename(x: Column | str) -> Column:
    return F.replace(F.regexp_replace(_c(x), r'[\\/*?:"<>|]', ""), F.lit(" "), F.lit("_"))


def content_hash(x: Column | str) -> Column:
    return F.md5(F.encode(_c(x), "UTF-8"))


def strip_fragment(x: Column | str) -> Column:
    return F.substring_index(_c(x), "#", 1)


def url_unquote(x: Column | str) -> Column:
    """Percent-escapes decoded; a plus sign stays, and text with a bad escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(_c(x), F.lit("+"), F.lit("%2B"))), _c(x))


def toc_uid(title: Column | str, index: Column) -> Column:
    """Identifier from a title: words in lower case joined by underscores, at most 50 characters, and the index."""
    kept = F.regexp_replace(_c(title), r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x85\p{Z}-]", "")
    slug = F.left(F.lower(F.regexp_replace(strip(kept), r"[\t-\r\x1c-\x20\x85\p{Z}-]+", "_")), F.lit(50))
    return F.when(F.coalesce(slug, F.lit("")) == "", F.concat(F.lit("toc_item_"), index.cast("string"))).otherwise(
        F.concat(F.lit("toc_"), slug, F.lit("_"), index.cast("string"))
    )


def escape_html(x: Column | str) -> Column:
    out = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape(x: Column | str) -> Column:
    r"""The escapes of a quoted reply undone: ``\"``, ``\'`` and ``\n``."""
    out = _c(x)
    for a, b in (('\\"', '"'), ("\\'", "'"), ("\\n", "\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_code_fence(x: Column | str) -> Column:
    """The inside of a text that is one fenced block, else the text."""
    fence = r"(?s)^```(?:json)?\s*(.*)\s*```$"
    return F.when(_c(x).rlike(fence), F.regexp_extract(_c(x), fence, 1)).otherwise(_c(x))


# Inline Markdown and the tags that it becomes, in this order.
INLINE_MARKDOWN = (
    (r"\[([^\]]+)\]\(([^\)]+)\)", '<a href="$2">$1</a>'),
    (r"`([^`]+)`", "<code>$1</code>"),
    (r"~~([^~]+)~~", "<del>$1</del>"),
    (r"\*\*(.+?)\*\*", "<strong>$1</strong>"),
    (r"__(.+?)__", "<strong>$1</strong>"),
    (r"(?<![*\w])\*([^*]+?)\*(?![*\w])", "<em>$1</em>"),
    (r"(?<!_)\b_([^_]+?)_\b(?!_)", "<em>$1</em>"),
)


def inline_markdown_to_html(x: Column | str) -> Column:
    """Links, code, deletions, strong and emphasised text as tags, in this order."""
    out = _c(x)
    for pattern, to in INLINE_MARKDOWN:
        out = F.regexp_replace(out, f"(?U){pattern}", to)
    return out


def similarity(a: Column | str, b: Column | str) -> Column:
    """Likeness of two normalised texts in [0, 1].

    If either is shorter than 50 characters and the shorter lies within the longer, the share of their lengths;
    else the Jaccard coefficient of their characters (if either has CJK letters) or lower-case words. Texts of equal
    length contain one another only if they are equal. Null or empty text is like nothing.
    """
    a, b = _c(a), _c(b)
    la, lb = F.char_length(a), F.char_length(b)
    shorter, longer = F.when(la <= lb, a).otherwise(b), F.when(la <= lb, b).otherwise(a)
    inside = ((la < 50) | (lb < 50)) & F.contains(longer, shorter)
    chars = [F.array_distinct(F.split(F.replace(x, F.lit(" "), F.lit("")), "")) for x in (a, b)]
    words = [F.array_distinct(F.filter(F.split(F.lower(x), f"{SPACE}+"), lambda w: w != "")) for x in (a, b)]

    def jaccard(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))

    by_sets = F.when(has_cjk(a) | has_cjk(b), jaccard(*[F.filter(c, lambda w: w != "") for c in chars])).otherwise(jaccard(*words))
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(inside, F.least(la, lb) / F.greatest(la, lb)).otherwise(by_sets)


def thousands(x: Column | str) -> Column:
    return F.coalesce(F.format_number(_c(x), 0), F.lit("N/A"))


def mime_type(path: Column | str) -> Column:
    """MIME type of an image by its extension; JPEG if unknown."""
    ext = F.lower(F.element_at(F.split(_c(path), r"\."), -1))
    return F.when(ext == "png", "image/png").when(ext == "gif", "image/gif").when(ext == "webp", "image/webp").when(ext == "svg", "image/svg+xml").otherwise("image/jpeg")


def data_url(path: Column | str, content: Column | str) -> Column:
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), F.base64(_c(content)))


def last_segment_id(markdown: Column | str) -> Column:
    """Number of the last segment marked in a rendered text, by the newer marks or else the older; -1 without any."""
    newer = F.element_at(F.regexp_extract_all(_c(markdown), F.lit(r"🔖 \*\*Segment (\d+)\*\*"), F.lit(1)), -1)
    older = F.element_at(F.regexp_extract_all(_c(markdown), F.lit(r"### Segment (\d+)"), F.lit(1)), -1)
    with_newer = F.size(F.regexp_extract_all(_c(markdown), F.lit(r"🔖 \*\*Segment (\d+)\*\*"), F.lit(1))) > 0
    with_older = F.size(F.regexp_extract_all(_c(markdown), F.lit(r"### Segment (\d+)"), F.lit(1))) > 0
    return F.when(with_newer, newer.cast("bigint")).when(with_older, older.cast("bigint")).otherwise(F.lit(-1).cast("bigint"))
