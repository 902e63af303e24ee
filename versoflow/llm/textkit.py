"""Sentence and token rules shared by the operators of this subpackage.

Texts are tokenised a batch at a time: the texts of a batch are joined by NUL, one regular expression cuts
the whole batch, and every distinct token gets a small integer. All further work is on integer arrays, so
the Python cost of a text is one C-level scan and one dictionary lookup per token.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

# The marks that end a sentence and those that may close it.
ENDS = ".!?…"
WIDE_ENDS = "。！？"
CLOSERS = "”’\"')]）】」』»"

_E, _W, _C = re.escape(ENDS), WIDE_ENDS, re.escape(CLOSERS)
_BREAK = re.compile(rf"[\r\n]+|[{_W}][{_E}{_W}]*[{_C}]*|[{_E}]+[{_C}]*(?=\s|$)")

#: Kinds of token. Words have ids from FIRST_WORD on.
DOC, LINE, STOP, FENCE, PIPE, HASH, FIRST_WORD = 0, 1, 2, 3, 4, 5, 6

_HAN = "㐀-鿿豈-﫿々〆"
_KANA = "぀-ヿｦ-ﾟ"
_TOKEN = re.compile(
    rf"\x00|[\r\n]+|[{_W}][{_E}{_W}]*[{_C}]*|[{_E}]+[{_C}]*(?=[\s\x00]|$)|```|\||#+"
    rf"|[{_HAN}]{{1,2}}|[぀-ゟ]+|[゠-ヿｦ-ﾟ]+"
    rf"|[^\W\d_{_HAN}{_KANA}]+(?:['’][^\W\d_{_HAN}{_KANA}]+)*"
)
#: As _TOKEN, with numbers and with Han characters one by one: words to align by.
WORD_PATTERN = re.compile(r"\d+(?:[.,\u202f\u00a0 ]\d{3})*(?!\d)|" + _TOKEN.pattern.replace(f"[{_HAN}]{{1,2}}", f"[{_HAN}]"))
_KIND = {"\x00": DOC, "\r": LINE, "\n": LINE, "`": FENCE, "|": PIPE, "#": HASH} | dict.fromkeys(ENDS + WIDE_ENDS, STOP)


def sentences(text: str | None) -> list[str]:
    """The sentences of a text by the fixed counting rule; blank ones are left out. Null gives none."""
    if not text:
        return []
    out, at = [], 0
    for m in _BREAK.finditer(text):
        end = m.start() if m[0][0] in "\r\n" else m.end()
        if (s := text[at:end]).strip():
            out.append(s)
        at = m.end()
    if (s := text[at:]).strip():
        out.append(s)
    return out


class Vocabulary(dict):
    """Token -> id, filled on first sight. It is a cache of pure functions of the token, so it may be emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[str] = []

    def __missing__(self, token: str) -> int:
        kind = _KIND.get(token[0])
        if kind is None:
            kind = FIRST_WORD + len(self.words)
            self.words.append(token)
        self[token] = kind
        return kind


def token_ids(texts: list[str | None], vocabulary: Vocabulary, pattern: re.Pattern = _TOKEN) -> np.ndarray:
    """Token ids of all texts in order, each text followed by one DOC."""
    joined = "\x00".join((t or "").replace("\x00", " ") for t in texts) + "\x00"
    if not joined.isascii():
        joined = unicodedata.normalize("NFC", joined)
    found = pattern.findall(joined.lower())
    return np.fromiter(map(vocabulary.__getitem__, found), dtype=np.int64, count=len(found))


class Sentences:
    """The sentences of a batch of texts as arrays: first token, end token, text, and what kind of line it is."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        stop = ids <= STOP
        ends = np.flatnonzero(stop)
        self.start = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        self.end = ends
        self.kind = ids[ends]
        doc_ends = np.cumsum(ids == DOC)
        self.doc = doc_ends[ends] - (self.kind == DOC)
        fences = np.cumsum(ids == FENCE)
        before = np.concatenate(([0], fences))[self.start]
        last = np.concatenate(([0], fences[np.flatnonzero(ids == DOC)]))[self.doc]
        inside = np.concatenate(([0], fences))[ends] - before
        self.code = ((before - last) % 2 == 1) | (inside > 0)
        pipes = np.concatenate(([0], np.cumsum(ids == PIPE)))
        self.table = pipes[ends] - pipes[self.start] >= 2
        first = ids[np.minimum(self.start, max(0, len(ids) - 1))] if len(ids) else ids
        self.heading = (first == HASH) & (self.end > self.start)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each sentence of a value per token; columns if there are several values."""
        total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
        return total[self.end] - total[self.start]


#: What makes a piece of text leave a token.
_HELD = re.compile(r"[^\W_]|[|#]|```")


def numbered_sentences(texts: list[str | None], s: Sentences) -> np.ndarray:
    """Number of each token sentence by the counting rule, from 1 in each text; 0 for those without tokens.

    A text's tokens fall into as many sentences as the rule counts, unless some hold only signs; those texts are
    matched part by part.
    """
    has = s.end > s.start
    docs = len(texts)
    number = np.zeros(len(s.start), dtype=np.int64)
    if not docs:
        return number
    before = np.concatenate(([0], np.cumsum(has)))
    first = np.searchsorted(s.doc, np.arange(docs + 1))
    number[has] = (before[1:] - before[first[:-1]][s.doc])[has]
    counted = before[first[1:]] - before[first[:-1]]
    for d, text in enumerate(texts):
        parts = sentences(text)
        if len(parts) != counted[d]:
            held = [i for i, p in enumerate(parts, 1) if _HELD.search(p)]
            mine = np.flatnonzero(has[first[d] : first[d + 1]]) + first[d]
            n = min(len(held), len(mine))
            number[mine[:n]] = held[:n]
            number[mine[n:]] = 0
    return number
