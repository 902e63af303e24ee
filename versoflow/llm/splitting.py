"""Problem 3: oversized texts cut at natural boundaries into overlapping pieces under their limit.

Method: lexical-cohesion segmentation. At every boundary the words of a block of sentences before it are compared
with those of a block behind it; valleys of this similarity mark changes of topic. In the window of sizes that a
piece may have, the deepest valley is chosen, where higher boundaries (chapter, paragraph, line) count as deeper;
without a sentence boundary the cut falls at a word-like boundary, else between visible characters. Each further
piece starts with ``overlap_chars`` of the piece before it (all of it if it is shorter, and at most one less than the
limit), more if that start lay inside a visible character, as far as the limit leaves room for it.

Defined results: null and fitting values have no pieces. Fields without a limit are ignored; of repeated limits
of a field the smallest holds. The new parts of the pieces, joined in order, are the text again. A visible
character longer than a whole piece is cut. Repeated rows are cut each for itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoflow.llm.textkit import CLOSERS, ENDS, WIDE_ENDS

#: Ranks of boundaries, and how much of a valley's depth each is worth.
CHAPTER, PARAGRAPH, LINE, SENTENCE, WORD, CHARACTER = "chapter", "paragraph", "line", "sentence", "word", "character"
WORTH = {CHAPTER: 2.0, PARAGRAPH: 1.0, LINE: 0.5, SENTENCE: 0.0}
#: Sentences in the blocks compared, and the least share of the limit that a piece fills where boundaries allow it.
BLOCK, LEAST = 4, 0.5

_CUT = re.compile(
    rf"(?P<para>\r?\n[^\S\r\n]*(?:\r?\n[^\S\r\n]*)+)|(?P<line>[\r\n]+|\s>\s)|(?P<sent>[{WIDE_ENDS}][{re.escape(ENDS)}{WIDE_ENDS}]*[{re.escape(CLOSERS)}]*\s*|[{re.escape(ENDS)}]+[{re.escape(CLOSERS)}]*(?:[^\S\r\n]+|(?=[\r\n])|$))"
)
_CHAPTER = re.compile(r"#{1,6} |(?:chapter|kapitel|chapitre|capítulo)\s+\w+|第.{1,6}[章节節]", re.I)
_WORDLIKE = re.compile(r"\s+|[，、；：,;:)\]）】」』»]+\s*")
_CHARACTER = regex.compile(r"\X")
_WORDS = re.compile(r"[㐀-鿿]{1,2}|[^\W\d_]{3,}")


def boundaries(text: str) -> list[tuple[int, str]]:
    """(place, rank) of every boundary of sentence rank or above; a piece may end at the place."""
    out: dict[int, str] = {}
    for m in _CUT.finditer(text):
        rank = PARAGRAPH if m["para"] else LINE if m["line"] else SENTENCE
        if rank != SENTENCE and _CHAPTER.match(text, m.end()):
            rank = CHAPTER
        if m.end() > 0:
            out[m.end()] = rank
    return sorted(out.items())


def valley_depths(text: str, places: list[int]) -> list[float]:
    """Depth of the similarity valley at each place: how far it lies below the peaks on both sides."""
    starts = [0, *places]
    bags = [Counter(_WORDS.findall(text[a:b].lower())) for a, b in zip(starts, [*places, len(text)])]
    similarity = []
    for k in range(1, len(bags)):
        left, right = Counter(), Counter()
        for bag in bags[max(0, k - BLOCK) : k]:
            left.update(bag)
        for bag in bags[k : k + BLOCK]:
            right.update(bag)
        dot = sum(n * right[w] for w, n in left.items())
        norm = (sum(n * n for n in left.values()) * sum(n * n for n in right.values())) ** 0.5
        similarity.append(dot / norm if norm else 0.0)
    # the peak to either side: as far as similarity doesn't fall on the way there
    left, right = similarity[:], similarity[:]
    for k in range(1, len(similarity)):
        if similarity[k - 1] >= similarity[k]:
            left[k] = left[k - 1]
    for k in range(len(similarity) - 2, -1, -1):
        if similarity[k + 1] >= similarity[k]:
            right[k] = right[k + 1]
    return [a + b - 2 * c for a, b, c in zip(left, right, similarity)]


def _visible(text: str, start: int, end: int) -> list[int]:
    """Ends of the visible characters of text[start:end], reading on from a boundary at start."""
    out = []
    for m in _CHARACTER.finditer(text, start):
        if m.end() > end:
            break
        out.append(m.end())
    return out


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, where new text starts, end, rank of the end) of the pieces of a text longer than the limit."""
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    marks = boundaries(text)
    places = [p for p, _ in marks]
    depths = valley_depths(text, places) if marks else []
    out: list[tuple[int, int, int, str]] = []
    start = new = 0
    k = 0
    while new < len(text):
        end_at_most = start + limit
        if end_at_most >= len(text):
            out.append((start, new, len(text), "end"))
            break
        while k < len(places) and places[k] <= new:
            k += 1
        within = []
        for i in range(k, len(places)):
            if places[i] > end_at_most:
                break
            within.append(i)
        full = [i for i in within if places[i] >= start + LEAST * limit]
        if full:
            best = max(full, key=lambda i: (depths[i] + WORTH[marks[i][1]], places[i]))
            end, rank = marks[best]
        elif within:
            end, rank = marks[within[-1]]
        else:
            words = [m.end() for m in _WORDLIKE.finditer(text, new, end_at_most) if m.end() > new]
            if words and words[-1] < end_at_most or words and words[-1] == end_at_most:
                end, rank = words[-1], WORD
            else:
                ends = _visible(text, new, end_at_most)
                end, rank = (ends[-1], CHARACTER) if ends else (end_at_most, CHARACTER)
        out.append((start, new, end, rank))
        piece_start, new = start, end
        start = max(new - overlap, piece_start + 1) if overlap else new
        if 0 < start < new:
            # never start inside a visible character: step back to the last boundary at or before the start
            moved = [piece_start, *_visible(text, piece_start, start)][-1]
            if moved + limit > new and moved > piece_start:
                start = moved
    return out


PIECES = "row_id bigint, field string, piece_no int, first_char int, new_from_char int, end_char int, boundary string, piece string"
_ARROW = pa.schema([
    ("row_id", pa.int64()), ("field", pa.string()), ("piece_no", pa.int32()), ("first_char", pa.int32()), ("new_from_char", pa.int32()),
    ("end_char", pa.int32()), ("boundary", pa.string()), ("piece", pa.string()),
])


def _mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for row_id, field, text, limit, overlap in zip(*(batch.column(c).to_pylist() for c in ("row_id", "field", "text", "max_chars", "overlap_chars"))):
            rows += [(row_id, field, n, a, new, b, rank, text[a:b]) for n, (a, new, b, rank) in enumerate(split(text, limit, overlap), 1)]
            if len(rows) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def pieces(segments: DataFrame, limits: DataFrame, fields: tuple[str, ...] = ("original_text", "chapter_title")) -> DataFrame:
    """The pieces of every value above its limit. Limits are one row a text column, so they are broadcast.

    The length test runs in the JVM before any text reaches Python; there is no shuffle.
    """
    wanted = limits.where(F.col("field").isin(*fields) & (F.col("max_chars") > 0)).groupBy("field").agg(
        F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))).alias("limit")
    )
    wanted = wanted.select("field", F.col("limit.max_chars").alias("max_chars"), F.col("limit.overlap_chars").alias("overlap_chars"))
    of = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]))
    values = segments.select(F.col("row_id").cast("long").alias("row_id"), of.alias("v")).select("row_id", "v.field", "v.text").where("text is not null")
    over = values.join(F.broadcast(wanted), "field").where(F.char_length("text") > F.col("max_chars"))
    return over.select("row_id", "field", "text", "max_chars", "overlap_chars").mapInArrow(_mapper, PIECES)


def found(segments: DataFrame, limits: DataFrame) -> DataFrame:
    """The values that were cut: row and field of every first piece."""
    return pieces(segments, limits).where("piece_no = 1").select("row_id", "field")
