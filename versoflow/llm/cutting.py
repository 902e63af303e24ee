"""Texts of a batch cut into sentences and words, as arrays.

The texts of a batch are joined and looked at as UTF-16 units in numpy: classes of characters give the boundaries, and
prefix sums of a polynomial give every word a 64-bit key, so that no Python object a word is made. A word's characters
are read only when its key is met for the first time.

Sentences follow the counting rule: breaks at CR and LF; after a run of end marks and the closing marks behind it where
white space or the end of the line follows, or whatever follows if a wide mark is in the run; blank ones don't count.
Null texts have no sentences. Upper and lower case and composed and decomposed characters have the same key.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from versoflow.llm.charlm import KneserNey, NaiveBayes
from versoflow.llm.textkit import CLOSERS, ENDS, WIDE_ENDS

OTHER, LATIN, HAN, HIRAGANA, KATAKANA, DIGIT, SPACE, BREAK, NUL, NARROW, WIDE, CLOSER, APOSTROPHE, HASH, PIPE, TICK, COMBINING = range(17)

_P = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_P, -1, 2**64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every UTF-16 unit; surrogates are of no class."""
    kind, lower = np.zeros(65536, dtype=np.uint8), np.arange(65536, dtype=np.uint16)
    for i in range(65536):
        c = chr(i)
        if c.isalnum():
            kind[i] = DIGIT if c.isdecimal() else LATIN
        elif c.isspace():
            kind[i] = SPACE
        elif unicodedata.combining(c):
            kind[i] = COMBINING
        small = c.lower()
        if len(small) == 1:
            lower[i] = ord(small)
    for a, b, k in ((0x3400, 0x9FFF, HAN), (0xF900, 0xFAFF, HAN), (0x3005, 0x3006, HAN), (0x3040, 0x309F, HIRAGANA), (0x30A0, 0x30FF, KATAKANA), (0xFF66, 0xFF9F, KATAKANA)):
        kind[a : b + 1] = k
    for marks, k in ((ENDS, NARROW), (WIDE_ENDS, WIDE), (CLOSERS, CLOSER), ("'’", APOSTROPHE), ("\r\n", BREAK), ("\x00", NUL), ("#", HASH), ("|", PIPE), ("`", TICK)):
        kind[[ord(c) for c in marks]] = k
    return kind, lower


_powers = {"p": np.ones(1, dtype=np.uint64), "q": np.ones(1, dtype=np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if len(_powers["p"]) < n:
        size = max(n, 2 * len(_powers["p"]), 1 << 16)
        for name, base in (("p", np.uint64(_P)), ("q", _INVERSE)):
            a = np.full(size, base)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"], _powers["q"]


#: Separators inside numbers, as in 1,234 or 1 234.
_SEPARATORS = [ord(c) for c in ".,   "]


def distinct(a: np.ndarray) -> np.ndarray:
    """The distinct numbers, ascending."""
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


class Cut:
    """Sentences (``start``, ``end``, ``doc``, ``number``, ``first``, ``last`` token and flags) and words (``key``,
    ``script``, ``letters``, ``sentence``) of texts. ``han``: characters of a word of Han; ``numbers``: numbers are words."""

    def __init__(self, texts: list[str | None], han: int = 2, numbers: bool = False) -> None:
        kinds, lower = _tables()
        chars = _units(texts)
        cls = kinds[chars]
        if len(marks := np.flatnonzero(cls == COMBINING)):
            texts = list(texts)
            for d in distinct(np.searchsorted(np.flatnonzero(chars == 0), marks) - 1):
                texts[d] = unicodedata.normalize("NFC", texts[d].replace("\x00", " "))
            chars = _units(texts)
            cls = kinds[chars]
        at = np.flatnonzero(cls == APOSTROPHE)
        cls[at[(cls[at - 1] == LATIN) & (cls[at + 1] == LATIN)]] = LATIN
        if numbers:
            chars, cls = _without_separators(chars, cls)
        self.chars, self.docs = lower[chars], len(texts)
        self._sentences(cls)
        self._words(cls, han, numbers)

    def _sentences(self, cls: np.ndarray) -> None:
        nul = np.flatnonzero(cls == NUL)
        m = np.flatnonzero((cls == NARROW) | (cls == WIDE))
        ends = np.zeros(0, dtype=np.int64)
        if len(m):
            head = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1] + 1)))
            wide = np.logical_or.reduceat(cls[m] == WIDE, head)
            ends = m[np.append(head[1:], len(m)) - 1] + 1
            while (more := (cls[ends] == CLOSER) | (cls[ends] == APOSTROPHE)).any():
                ends = ends + more
            ends = ends[wide | ((cls[ends] >= SPACE) & (cls[ends] <= NUL))]
        blank = (cls >= SPACE) & (cls <= NUL)
        cuts = distinct(np.concatenate((nul, np.flatnonzero(cls == BREAK), ends)))
        closed = np.zeros(len(cuts), dtype=bool)
        closed[np.searchsorted(cuts, ends) - 1] = True
        some = np.logical_or.reduceat(~blank, cuts[:-1]) if len(cuts) > 1 else np.zeros(0, dtype=bool)
        self.start, self.end, self.closed = cuts[:-1][some], cuts[1:][some], closed[:-1][some]
        self.doc = np.searchsorted(nul, self.start, side="right") - 1
        self.of_doc = np.searchsorted(self.doc, np.arange(self.docs + 1))
        self.number = np.arange(len(self.doc)) - self.of_doc[self.doc] + 1
        self.heading, self.table, self.code = (np.zeros(len(self.doc), dtype=bool) for _ in range(3))
        within = lambda p: np.searchsorted(p, self.end) - np.searchsorted(p, self.start)
        if len(p := np.flatnonzero(cls == PIPE)):
            self.table = within(p) >= 2
        if len(p := np.flatnonzero(cls == HASH)) and len(self.doc):
            seen = np.concatenate(([0], np.cumsum(~blank, dtype=np.int64)))
            k = np.minimum(np.searchsorted(p, self.start), len(p) - 1)
            self.heading = (p[k] >= self.start) & (p[k] < self.end) & (seen[p[k]] == seen[self.start])
        if len(p := np.flatnonzero(cls == TICK)):
            head = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1] + 1)))
            p = p[head[np.diff(np.append(head, len(p))) >= 3]]
            self.code = ((np.searchsorted(p, self.start) - np.searchsorted(p, nul[self.doc])) % 2 == 1) | (within(p) > 0)

    def _words(self, cls: np.ndarray, han: int, numbers: bool) -> None:
        w = np.where(cls <= (DIGIT if numbers else KATAKANA), cls, 0)
        begin = np.flatnonzero(w[1:] != w[:-1]) + 1
        end = np.append(begin[1:], len(w))
        kind = w[begin]
        live = kind > 0
        begin, end, kind = begin[live], end[live], kind[live]
        pieces = np.where(kind == HAN, -(-(end - begin) // han), 1)
        of = np.repeat(np.arange(len(begin)), pieces)
        step = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.script = kind[of]
        self.begin = begin[of] + han * step
        self.stop = np.where(self.script == HAN, np.minimum(self.begin + han, end[of]), end[of])
        self.letters = np.where(self.script == DIGIT, 0, self.stop - self.begin)
        p, q = _power(len(cls))
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((self.chars.astype(np.uint64) + np.uint64(1)) * p[: len(cls)], dtype=np.uint64)))
            key = (sums[self.stop] - sums[self.begin]) * q[self.begin] * _MIX
            self.key = (key ^ (key >> np.uint64(31))) * _MIX
        self.first, self.last = np.searchsorted(self.begin, self.start), np.searchsorted(self.begin, self.end)
        self.sentence = np.repeat(np.arange(len(self.start)), self.last - self.first)

    def word(self, k: int) -> str:
        return self.chars[self.begin[k] : self.stop[k]].tobytes().decode("utf-16-le", "replace")

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each sentence of a value (or a row of values) a word."""
        total = np.zeros((len(self.start), *values.shape[1:]))
        some = np.flatnonzero(self.last > self.first)
        if len(some):
            total[some] = np.add.reduceat(values, self.first[some], axis=0, dtype=np.float64)
        return total


def paired(before: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Key of two words that follow one another."""
    with np.errstate(over="ignore"):
        x = (before * np.uint64(0x9FB21C651E98DF25)) ^ key
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _units(texts: list[str | None]) -> np.ndarray:
    """The UTF-16 units of all texts, with a NUL before each and at the end."""
    joined = "".join(["\x00" + (t.replace("\x00", " ") if t else "") for t in texts]) + "\x00"
    return np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)


def _without_separators(chars: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text without the separators before groups of exactly three digits of a number."""
    d = np.flatnonzero(cls == DIGIT)
    if not len(d):
        return chars, cls
    head = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1] + 1)))
    begin, end = d[head], d[np.append(head[1:], len(d)) - 1] + 1
    joins = (begin[1:] == end[:-1] + 1) & (end[1:] - begin[1:] == 3) & np.isin(chars[end[:-1]], _SEPARATORS)
    if not joins.any():
        return chars, cls
    keep = np.ones(len(chars), dtype=bool)
    keep[end[:-1][joins]] = False
    return chars[keep], cls[keep]


class WordScores:
    """Vectors of words by key, one log-probability a language, computed once a distinct word.

    A direct-address table finds nearly every word in one step; sorted keys find the others. ``limit`` bounds the memory
    of this cache, which may be emptied since it holds pure functions of the words.
    """

    BITS = 18

    def __init__(self, model: KneserNey | NaiveBayes, limit: int = 300_000) -> None:
        self.model, self.limit = model, limit
        self._empty()

    def _empty(self) -> None:
        self.slots = np.zeros(1 << self.BITS, dtype=np.int32)
        self.keys = np.zeros(1, dtype=np.uint64)
        self.scores = np.zeros((1, len(self.model.langs)))
        self.sorted, self.order = self.keys[1:], np.zeros(0, dtype=np.int64)

    def rows(self, cut: Cut) -> np.ndarray:
        """Row of ``scores`` of every word of the batch."""
        if len(self.keys) > self.limit:
            self._empty()
        slot = (cut.key >> np.uint64(64 - self.BITS)).astype(np.int64)
        row = self.slots[slot]
        missed = np.flatnonzero(self.keys[row] != cut.key)
        if len(missed):
            wanted = cut.key[missed]
            at = np.searchsorted(self.sorted, wanted)
            known = np.zeros(len(at), dtype=bool)
            if len(self.sorted):
                known = self.sorted[np.minimum(at, len(self.sorted) - 1)] == wanted
            fresh = np.flatnonzero(~known)
            if len(fresh):
                order = fresh[np.argsort(wanted[fresh])]
                first = order[np.concatenate(([True], wanted[order[1:]] != wanted[order[:-1]]))]
                self._add(cut, wanted[first], missed[first])
                at = np.searchsorted(self.sorted, wanted)
            row[missed] = self.order[at]
        return row

    def _add(self, cut: Cut, keys: np.ndarray, at: np.ndarray) -> None:
        words = [cut.word(k) for k in at]
        scores = self.model.score(words)
        scores[cut.script[at] == DIGIT] = 0.0  # numbers say nothing about a language
        row = np.arange(len(self.keys), len(self.keys) + len(keys))
        self.keys, self.scores = np.concatenate((self.keys, keys)), np.concatenate((self.scores, scores))
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        free = self.slots[slot] == 0
        self.slots[slot[free]] = row[free]
        at = np.searchsorted(self.sorted, keys)
        self.sorted, self.order = np.insert(self.sorted, at, keys), np.insert(self.order, at, row)


class Rated:
    """Sentences of a batch with their log-probability in each language, and their words and letters that count.

    Latin words say nothing in a sentence of Chinese or Japanese, and the other way round; Japanese sentences have kana,
    so one of at least ``kana_from`` Han characters without any is held not to be Japanese. Letters in unbroken ``runs``
    (of Latin letters, of Han and kana) at least so long don't count.
    """

    def __init__(self, cut: Cut, scores: WordScores, kana_from: int, runs: tuple[int, int] | None = None) -> None:
        row = scores.rows(cut)
        latin, digit = cut.script == LATIN, cut.script == DIGIT
        held = np.ones(len(cut.key)) if runs is None else ~_in_runs(cut, latin, runs) * 1.0
        letters = cut.letters * held
        self.wide, self.latin = cut.sums(letters * ~(latin | digit)), cut.sums(letters * latin)
        self.is_wide = 3 * self.wide >= self.latin
        self.words = cut.sums(held)
        counts = held * (digit | (latin != self.is_wide[cut.sentence]))
        self.total = cut.sums(scores.scores[row] * counts[:, None])
        if "ja" in scores.model.langs:
            kana = cut.sums(held * ((cut.script == HIRAGANA) | (cut.script == KATAKANA)))
            self.total[:, scores.model.langs.index("ja")] -= np.where((kana == 0) & (self.wide >= kana_from), self.wide, 0.0)


def _in_runs(cut: Cut, latin: np.ndarray, runs: tuple[int, int]) -> np.ndarray:
    """Whether a word is part of an unbroken run: a Latin word, or words of Han and kana that touch."""
    if not len(latin):
        return latin
    head = np.flatnonzero(np.concatenate(([True], latin[1:] | latin[:-1] | (cut.begin[1:] != cut.stop[:-1]))))
    length = np.add.reduceat(cut.stop - cut.begin, head)
    of = np.repeat(length, np.diff(np.append(head, len(latin))))
    return of >= np.where(latin, *runs)


#: Rows and characters of a batch that are held in arrays at a time.
ROWS, CHARACTERS = 1000, 1_000_000


def slices(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Batches cut to at most so many rows and, but for single rows, CHARACTERS characters, with the columns as lists."""
    for batch in batches:
        lists = [batch.column(c).to_pylist() for c in columns]
        sizes = np.cumsum([0, *(sum(len(t) for t in row if t) for row in zip(*lists))])
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHARACTERS, side="right")) - 1))
            yield batch.slice(at, to - at), [x[at:to] for x in lists]
            at = to
