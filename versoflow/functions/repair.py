"""Reading the replies of language models that should be JSON and often aren't.

A reply is tried as JSON; failing that, pairs are picked out of it by patterns, from strict to loose, the first that
finds anything winning. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versoflow.functions.text import MISSING_IN_RESPONSE, MISSING_TRANSLATION, PARSE_ERROR, strip, strip_code_fence, unescape

# The patterns of (id, translation) pairs, from strict to loose.
PAIR_PATTERNS = (
    r'(?s)"id":\s*(\d+),\s*"translation":\s*"((?:[^"\\]|\\.)*)"\s*\}',
    r'(?s)"id":\s*(\d+),\s*"translation":\s*"((?:[^"\\]|\\.)*?)"',
    r"(?s)'id':\s*(\d+),\s*'translation':\s*'((?:[^'\\]|\\.)*)'",
    r'(?s)"id"\s*:\s*(\d+)[^}]*"translation"\s*:\s*"([^"]*?)(?:"|$)',
)
# Patterns of entries of a flat dictionary, keys that aren't entries, endings of a whole sentence, and
# what is put behind a text that was cut.
ENTRY_PATTERNS = (r'(?s)"([^"]+)"\s*:\s*"([^"]*)"', r"(?s)'([^']+)'\s*:\s*'([^']*)'")
META_KEYS = ("id", "type", "status", "error")
SENTENCE_END = r"[。！？.!?」\")）]$"
CUT_MARK = "[...翻译被截断]"

_ITEMS = "array<struct<id:string,translation:string>>"


def strict_items(raw: Column) -> Column:
    """Items of a reply that is valid JSON: an array of {id, translation}; null if the reply isn't JSON at all.

    Ids may be numbers or strings; a missing translation is an empty one; items without an id are left out.
    """
    inner = strip_code_fence(raw)
    valid = F.try_parse_json(inner)
    items = F.from_json(F.when(F.ltrim(inner).startswith("["), inner), _ITEMS)
    kept = F.transform(F.filter(F.coalesce(items, F.array().cast(_ITEMS)), lambda x: x["id"].isNotNull()), lambda x: F.named_struct(F.lit("id"), x["id"], F.lit("translation"), F.coalesce(x["translation"], F.lit(""))))
    return F.when(valid.isNotNull(), kept)


def _possessive(pattern: str) -> str:
    """The pattern with its loops over quoted text made possessive: it finds the same, without recursion per character."""
    for q in ('"', "'"):
        for loop in (rf"(?:[^{q}\\]|\\.)*?", rf"(?:[^{q}\\]|\\.)*"):
            pattern = pattern.replace(loop, rf"(?:[^{q}\\]++|\\.)*+")
    return pattern


def _pairs(raw: Column, pattern: str) -> Column:
    pattern = _possessive(pattern)
    ids = F.regexp_extract_all(raw, F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(raw, F.lit(pattern), F.lit(2))
    return F.zip_with(ids, texts, lambda i, t: F.named_struct(F.lit("id"), i, F.lit("translation"), t))


def fallback_items(raw: Column, patterns: tuple[str, ...] = PAIR_PATTERNS) -> Column:
    """Items picked out by the first pattern that finds any; empty if none does.

    Of a reply that doesn't end with a bracket, the last item (and any equal to it) was cut if it doesn't end a
    sentence; it is marked so.
    """
    found = F.array().cast(_ITEMS)
    for p in reversed(patterns):
        found = F.when(F.size(_pairs(raw, p)) > 0, _pairs(raw, p).cast(_ITEMS)).otherwise(found)
    cut = ~F.coalesce(F.regexp_replace(raw, r"(?U)\s+$", "").endswith("]"), F.lit(False))
    last = F.when(F.size(found) > 0, F.element_at(found, -1))
    trimmed = lambda t: F.regexp_replace(t, r"(?U)\s+$", "")
    text = lambda x: unescape(x["translation"])
    marked = lambda x: cut & (x["id"] == last["id"]) & (x["translation"] == last["translation"]) & (text(x) != "") & ~trimmed(text(x)).rlike(SENTENCE_END)
    return F.transform(found, lambda x: F.named_struct(F.lit("id"), x["id"], F.lit("translation"), F.when(marked(x), F.concat(text(x), F.lit(CUT_MARK))).otherwise(text(x))))


def fallback_entries(raw: Column) -> Column:
    """Entries of a reply that should be a flat dictionary, by the first quoting style that gives any."""

    def entries(pattern: str) -> Column:
        keys, values = (F.regexp_extract_all(raw, F.lit(pattern), F.lit(k)) for k in (1, 2))
        zipped = F.zip_with(keys, values, lambda k, v: F.named_struct(F.lit("k"), k, F.lit("v"), v))
        return F.filter(zipped, lambda e: ~F.lower(e["k"]).isin(*META_KEYS))

    double, single = (entries(p) for p in ENTRY_PATTERNS)
    chosen = F.when(F.size(double) > 0, double).otherwise(single)
    return F.transform(chosen, lambda e: F.named_struct(F.lit("k"), unescape(e["k"]), F.lit("v"), unescape(e["v"])))


def parse_responses(responses: DataFrame) -> DataFrame:
    """One row for each expected id of each reply: the translation, or a marker of what went wrong.

    In: doc_id, batch_id, expected_ids, raw_text. Out: doc_id, batch_id, segment_id, translation, route (``strict``,
    ``fallback`` or ``failed``). Of an id that a reply has twice the last counts; ids that weren't asked for are left
    out. A null reply counts as one that can't be read; a null or empty list of ids gives no rows.
    """
    raw = F.coalesce("raw_text", F.lit(""))
    strict, loose = strict_items(raw), fallback_items(raw)
    # patterns are only tried on what isn't JSON
    read = responses.select("doc_id", "batch_id", "expected_ids", strict.isNotNull().alias("valid"), F.when(strict.isNotNull(), strict).otherwise(loose).alias("items"))
    route = F.when(F.col("valid"), "strict").when(F.size("items") > 0, "fallback").otherwise("failed")
    held = read.select("doc_id", "batch_id", F.explode("expected_ids").alias("segment_id"), "items", route.alias("route"))
    mine = F.filter("items", lambda x: x["id"].rlike(r"^\d+$") & (x["id"].cast("bigint") == F.col("segment_id")))
    got = F.when(F.size(mine) > 0, F.element_at(mine, -1)["translation"])
    missing = F.when(F.col("route") == "strict", MISSING_TRANSLATION).when(F.col("route") == "fallback", MISSING_IN_RESPONSE).otherwise(PARSE_ERROR)
    return held.select("doc_id", "batch_id", "segment_id", F.coalesce(got, missing).alias("translation"), "route")


def flat_entries(raw: Column) -> Column:
    """Array of (k, v) from a reply of entries in any of the usual shapes, stripped, without blank keys and values.

    A dictionary of texts, a list of dictionaries (their ``id`` left out), or a list of pairs; if it isn't JSON, what
    patterns find. Of a key given twice both entries are kept, in order: the caller takes the last.
    """
    inner = strip(strip_code_fence(raw))
    pair = "array<struct<k:string,v:string>>"
    none = F.array().cast(pair)

    def of_map(m: Column) -> Column:
        return F.transform(F.map_entries(m), lambda e: F.named_struct(F.lit("k"), e["key"], F.lit("v"), e["value"]))

    valid = F.try_parse_json(inner).isNotNull()
    one = of_map(F.from_json(F.when(valid & F.startswith(inner, F.lit("{")), inner), "map<string,string>"))
    maps = F.from_json(F.when(valid & inner.rlike(r"^\[\s*\{"), inner), "array<map<string,string>>")
    many = F.flatten(F.transform(maps, of_map))
    lists = F.from_json(F.when(valid & inner.rlike(r"^\[\s*\["), inner), "array<array<string>>")
    pairs = F.transform(F.filter(lists, lambda x: F.size(x) >= 2), lambda x: F.named_struct(F.lit("k"), x[0], F.lit("v"), x[1]))
    found = F.coalesce(one, many, pairs, F.when(~valid, fallback_entries(raw)), none)
    clean = F.transform(found, lambda e: F.named_struct(F.lit("k"), strip(e["k"]), F.lit("v"), strip(e["v"])))
    return F.filter(clean, lambda e: (F.coalesce(e["k"], F.lit("")) != "") & (F.coalesce(e["v"], F.lit("")) != "") & (F.lower(e["k"]) != "id"))
