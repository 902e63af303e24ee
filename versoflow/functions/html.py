"""HTML: text, blocks, and putting translations in place of blocks; parsed by the standard library in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versoflow.functions.text import INLINE_MARKDOWN

# Tags that make a block, and tags whose text isn't read.
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre")
SILENT = ("script", "style")


def _clean(text: str) -> str:
    return "\n\n".join(x for x in (line.strip() for line in text.split("\n")) if x)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT

    def handle_endtag(self, tag):
        self.silent -= tag in SILENT and self.silent > 0

    def handle_data(self, data):
        if not self.silent and data.strip():
            self.parts.append(data.strip())


def html_text(html: str | None) -> str:
    """Text without scripts and styles, its non-blank lines joined by blank lines; empty for null."""
    if not html:
        return ""
    p = _Text()
    p.feed(html)
    p.close()
    return _clean("\n".join(p.parts))


class _Blocks(HTMLParser):
    """Blocks with their source range. A block that isn't closed ends where its parent or the next like block does."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.html = html
        self.lines = [0]
        for m in re.finditer("\n", html):
            self.lines.append(m.end())
        self.open: list[dict] = []
        self.blocks: list[dict] = []
        self.silent = 0
        self.feed(html)
        self.close()
        while self.open:
            self._end(len(html), len(html))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        if tag in BLOCKS and not self.silent:
            at = self._at()
            if tag != "blockquote" and self.open and self.open[-1]["tag"] != "blockquote" and (self.open[-1]["tag"] == tag or self.open[-1]["tag"] == "p"):
                self._end(at, at)
            block = {"tag": tag, "start": at, "inner": at + len(self.get_starttag_text() or ""), "texts": [], "leaf": True}
            for b in self.open:
                b["leaf"] = False
            self.open.append(block)
            self.blocks.append(block)

    def handle_endtag(self, tag):
        self.silent -= tag in SILENT and self.silent > 0
        if tag in BLOCKS and any(b["tag"] == tag for b in self.open):
            at = self._at()
            while True:
                last = self.open[-1]["tag"]
                end = self.html.find(">", at) + 1
                self._end(at, end if last == tag else at)
                if last == tag:
                    break

    def _end(self, inner_end: int, end: int) -> None:
        b = self.open.pop()
        b["inner_end"], b["end"] = inner_end, end or inner_end

    def handle_data(self, data):
        if not self.silent and data.strip():
            for b in self.open:
                b["texts"].append(data.strip())


def html_blocks(html: str | None) -> list[tuple[str, str]]:
    """(tag, text) of every block in document order; the text of a nested block is also in those around it."""
    if not html:
        return []
    return [(b["tag"], t) for b in _Blocks(html).blocks if (t := " ".join(" ".join(b["texts"]).split()))]


def replace_blocks(html: str | None, translations: dict[str, str], keep_original: bool = False) -> tuple[str | None, int]:
    """HTML with the innermost blocks' contents replaced by translations of their normalised texts, and how many were.

    With ``keep_original`` the translation comes first and the original content below it.
    """
    if not html:
        return html, 0
    out, at, n = [], 0, 0
    for b in sorted((b for b in _Blocks(html).blocks if b["leaf"]), key=lambda b: b["start"]):
        text = " ".join(" ".join(b["texts"]).split())
        translated = translations.get(text)
        if not text or not translated or b["inner"] < at:
            continue
        inner = html[b["inner"] : b["inner_end"]]
        new = inline_html(translated)
        if keep_original:
            new = f'<span class="translated">{new}</span><br/><span class="original">{inner}</span>'
        out += [html[at : b["inner"]], new]
        at = b["inner_end"]
        n += 1
    return "".join([*out, html[at:]]), n


def inline_html(text: str) -> str:
    """Escaped text with line ends as breaks and inline Markdown as tags."""
    text = escape(unescape(text), quote=False).replace("\n", "<br/>")
    for pattern, to in INLINE_MARKDOWN:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", to), text)
    return text


def extract_text(html: Column | str) -> Column:
    """Text of an HTML column, see ``html_text``."""

    @F.pandas_udf("string")
    def run(h: pd.Series) -> pd.Series:
        return h.map(html_text)

    return run(html)


def explode_blocks(pages: DataFrame, id_column: str, html: str = "html") -> DataFrame:
    """id, pos, tag, text of every block of every page; pages that are null or can't be parsed have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos, tags, texts = [], [], [], []
            for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = html_blocks(h)
                except Exception:
                    found = []
                for k, (tag, text) in enumerate(found):
                    ids.append(i), pos.append(k), tags.append(tag), texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int64()), pa.array(tags, pa.string()), pa.array(texts, pa.string())], [id_column, "pos", "tag", "text"])

    return pages.select(F.col(id_column).cast("bigint"), F.col(html).cast("string")).mapInArrow(run, f"`{id_column}` bigint, pos bigint, tag string, text string")


def refill(pages: DataFrame, entries: DataFrame, id_column: str, html: str = "html", keep_original: bool = False) -> DataFrame:
    """id, html, replaced: pages with their blocks translated.

    ``entries`` (id, text, translation) are the matches of each page's blocks; they are gathered by page only.
    """
    mine = entries.where("translation is not null").groupBy(F.col(id_column).alias("__id")).agg(F.collect_list(F.struct("text", "translation")).alias("__m"))

    @F.pandas_udf("html string, replaced int")
    def apply(h: pd.Series, m: pd.Series) -> pd.DataFrame:
        rows = [replace_blocks(x, {e["text"]: e["translation"] for e in (y if y is not None else [])}, keep_original) for x, y in zip(h, m)]
        return pd.DataFrame(rows, columns=["html", "replaced"])

    joined = pages.join(mine, pages[id_column] == mine["__id"], "left")
    out = joined.select(id_column, apply(html, F.coalesce("__m", F.array().cast("array<struct<text:string,translation:string>>"))).alias("r"))
    return out.select(id_column, "r.html", "r.replaced")
