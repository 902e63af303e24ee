"""Features of a reply beside its prompt, computed in one Python pass over both texts.

Problems 2 and 4 share this pass. Nothing here looks at other rows; what the corpus knows comes in later joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from versoflow.llm.charlm import NaiveBayes
from versoflow.llm.cutting import Cut, Rated, WordScores, paired, slices
from versoflow.llm.langid import readable
from versoflow.llm.refusal import Refusals
from versoflow.llm.sums import Sums
from versoflow.llm.textkit import CLOSERS

# The pipeline's failure markers.
_MARKER = re.compile(r"\s*\[(?:Translation )?Failed[^\]]*\]?\s*|[^\n]{0,200}Failed\]\s*")
_ESCAPE = re.compile(r"\\u[0-9a-fA-F]{0,3}$")
_TAGS = re.compile(r"<[^<>]*>")

_NOT_SPACE = re.compile(r"[\W_]+")
_BLANK = " \t\r\n  　"

#: States of a text's end.
MARK, ELLIPSIS, DASH, BLOCK, OPEN, BROKEN, UNCLOSED, NOTHING = range(8)


def is_marker(text: str) -> bool:
    return text.rstrip()[-1:] == "]" and bool(_MARKER.fullmatch(text)) or text.lstrip().startswith(("[Failed", "[Translation Failed"))


def is_empty(text: str | None) -> bool:
    """Null, nothing to read, or only a failure marker."""
    if not text or is_marker(text):
        return True
    if len(text) > 200:
        return not any(c.isalnum() for c in text)
    return not any(c.isalnum() for c in _TAGS.sub("", text))


def unwrap(text: str) -> str:
    """Without outer blanks, and without a fence or straight quotes that wrap the whole text."""
    text = text.strip(_BLANK + "﻿​")
    if text.startswith("```") and text.count("```") <= 2 and (text.endswith("```") and len(text) > 6 or text.count("```") == 1):
        body = text[3:].removesuffix("```")
        if body[:1] == "\n":
            text = body.strip(_BLANK)
    if len(text) > 2 and text[0] == '"' == text[-1] and text.count('"') % 2 == 0:
        text = text[1:-1].strip(_BLANK)
    return text


_PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』"}


def _unclosed(line: str) -> bool:
    """Whether a quotation mark that the last line opens stays open."""
    depth = []
    for c in line:
        if depth and c == depth[-1]:
            depth.pop()
        elif c in _PAIRS:
            depth.append(_PAIRS[c])
    return bool(depth)


def end_state(text: str | None) -> int:
    """How a text ends: with a mark, an ellipsis, a colon or dash, a closed block, openly, or broken."""
    if not text:
        return NOTHING
    text = unwrap(text)
    if not text:
        return NOTHING
    if text[-1] == "�" or _ESCAPE.search(text, max(0, len(text) - 8)):
        return BROKEN
    fences = text.count("```")
    if text.endswith("```") and fences % 2 == 0:
        return BLOCK
    last_line = text[max(text.rfind("\n"), text.rfind("\r")) + 1 :]
    if text[-1] in '"\\<{`' and not (text[-1] == "`" and text.endswith("```")):
        # a stray sign of the carrier: kept only where it closes something
        if text[-1] != '"' or text.count('"') % 2:
            inner = text.rstrip('"\\<{`' + _BLANK)
            return BROKEN if end_state(inner) in (OPEN, DASH, BROKEN, UNCLOSED) else end_state(inner)
    if last_line.lstrip().startswith("|") and last_line.rstrip().endswith("|"):
        return BLOCK
    if text[-1] == "]" and last_line.lstrip().startswith("["):
        return BLOCK
    core = text.rstrip(CLOSERS + _BLANK)
    if not core:
        return NOTHING
    if core.endswith(("…", "...")):
        return ELLIPSIS
    if core[-1] in ".!?。！？":
        if fences % 2:
            return OPEN
        if text[-1] not in CLOSERS and _unclosed(last_line):
            return UNCLOSED
        return MARK
    if core[-1] in ":：—–-;；":
        return DASH
    return OPEN


def prompt_state(text: str | None) -> int:
    """State of the end of a text's last line of prose: blocks, references and unbroken runs behind it are passed over."""
    state = end_state(text)
    if not text or state in (MARK, ELLIPSIS, DASH):
        return state
    inside = False
    for line in reversed(re.split(r"[\r\n]+", text)):
        line = line.strip()
        if line.startswith("```"):
            inside = not inside
        elif line and not inside and line[0] not in "|[#" and (len(line) < 60 or " " in line or line[-1] in ".!?…。！？" or "，" in line or "、" in line):
            return end_state(line)
    return state


def _squeezed(text: str) -> str:
    return _NOT_SPACE.sub("", text).casefold()


def copied(prompt: str, reply: str) -> bool:
    """Whether the reply is the prompt but for small changes: nine tenths of the trigrams of either are shared."""
    a, b = _squeezed(prompt), _squeezed(reply)
    if not a or not b:
        return False
    if a == b:
        return True
    for head in ("translation", "übersetzung", "traduction", "traducción", "翻译", "译文", "翻訳", "reply"):
        b = b.removeprefix(head)
    if a == b:
        return True
    x, y = {a[i : i + 3] for i in range(len(a) - 2)}, {b[i : i + 3] for i in range(len(b) - 2)}
    if not x or not y:
        return False
    both = len(x & y)
    # a copy that was cut off is still wholly the prompt's text, from its start
    return both >= 0.85 * len(y) and (both >= 0.8 * len(x) or len(b) < len(a) and both >= 0.95 * len(y) and a.startswith(b[: max(8, len(b) // 2)]))


FEATURES = (
    "row_id bigint, doc_id bigint, content_type string, prompt_blank boolean, empty boolean, refusal double, copy boolean, "
    "reply_lang string, prompt_lang string, reply_conf double, n_chars int, n_bytes int, prompt_end int, reply_end int, last_word bigint, last_two bigint, n_words int, n_ends int, "
    "bucket int, keys binary, sums binary"
)
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in FEATURES.split(", "))])
#: Buckets of the counts of words and of their pairs; partitions send one sum a word or pair.
BUCKETS = 64
#: Distinct words and pairs that a worker holds before it sends their counts on.
HELD = 2_000_000
#: In a sum of counts, the place of those at the end of a sentence.
FINAL = 32


class Posteriors:
    """Language of a whole text by character n-gram naive Bayes, from log-likelihoods of words."""

    def __init__(self, model: NaiveBayes) -> None:
        self.model, self.scores = model, WordScores(model)

    def of(self, texts: list[str | None]) -> tuple[Cut, np.ndarray, np.ndarray, np.ndarray]:
        """Sentences and words, the likeliest language (-1 without letters), its posterior, and how many sentences are
        clearly of each language."""
        cut = Cut(texts, han=1)
        rated = Rated(cut, self.scores, 4)
        size, docs, total = len(self.model.langs), cut.docs, rated.total
        weigh = ~cut.code & ~cut.table & (rated.wide + rated.latin > 0)
        sums = np.stack([np.bincount(cut.doc[weigh], total[weigh, k], minlength=docs) for k in range(size)], axis=1)
        got = np.bincount(cut.doc[weigh], minlength=docs) > 0
        z = np.exp(np.maximum(-60, (sums - sums.max(axis=1, keepdims=True)) * 0.5))
        # sentences clear of the text's language: long enough, and preferring another by a margin
        sure = weigh & ((rated.wide >= 5) | (rated.latin >= 14)) & ~cut.heading
        mixed = np.bincount(cut.doc[sure] * size + total.argmax(axis=1)[sure], minlength=docs * size).reshape(docs, size)
        return cut, np.where(got, sums.argmax(axis=1), -1), np.where(got, 1 / z.sum(axis=1), 0.0), mixed


def _count(sums: Sums, cut: Cut) -> np.ndarray:
    """Adds how often each word, and each word behind another of its sentence, occurs and ends a sentence; the pairs' keys."""
    final = np.zeros(len(cut.key), dtype=np.int64)
    closed = np.flatnonzero(cut.closed & ~cut.code & (cut.last > cut.first))  # ended by a mark, not by the end of the text
    final[cut.last[closed] - 1] = 1
    units = 1 + (final << FINAL)
    two = np.zeros(len(cut.key), dtype=np.uint64)
    inner = np.flatnonzero(cut.sentence[1:] == cut.sentence[:-1]) + 1
    two[inner] = paired(cut.key[inner - 1], cut.key[inner])
    for keys, n in ((cut.key, units), (two[inner], units[inner])):
        order = np.argsort(keys)
        keys = keys[order]
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else keys
        if len(head):
            sums.add(keys[head], np.add.reduceat(n[order], head))
    return two


def _last_words(cut: Cut, two: np.ndarray, ends: list[int]) -> tuple[list, list]:
    """Keys of the last word and of the last two words of texts whose end is open."""
    last = np.full(cut.docs, -1)
    some = np.flatnonzero(cut.last > cut.first)
    last[cut.doc[some]] = cut.last[some] - 1  # the last assignment stays
    one, pair = cut.key.view(np.int64), two.view(np.int64)
    asked = [k if k >= 0 and e in (OPEN, DASH, ELLIPSIS, UNCLOSED) else None for k, e in zip(last.tolist(), ends)]
    return [None if k is None else int(one[k]) for k in asked], [None if k is None or not pair[k] else int(pair[k]) for k in asked]


def mapper(broadcast, whole: bool):
    """Arrow mapper over (row_id, doc_id, content_type, prompt, reply).

    Emits a row of features for each input row and, at the end of its partition, the counts of words and of pairs of words
    of replies: how often they occur and how often a sentence ends with them. ``whole`` adds what only problem 2 needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = broadcast.value
        posteriors, refusals, sums = Posteriors(model), Refusals(weights), Sums()
        langs = model.langs
        names = np.array([*langs, ""], dtype=object)
        for batch, (prompts, replies) in slices(batches, ("prompt", "reply")):
            n = len(replies)
            blank = [not p or p.isspace() for p in prompts]
            empty = [is_empty(r) for r in replies]
            cut, best, conf, mixed = posteriors.of([None if e else readable(r) for e, r in zip(empty, replies)])
            two = _count(sums, cut)
            ends = [NOTHING if e else end_state(r) for e, r in zip(empty, replies)]
            one, pair = _last_words(cut, two, ends)
            copy, refusal, reply_lang, prompt_lang = [None] * n, [None] * n, [None] * n, [None] * n
            if whole:
                _, first, _, _ = posteriors.of([None if e or b else p for e, b, p in zip(empty, blank, prompts)])
                same = (best == first) | (best < 0)
                copy = [not e and not b and bool(k) and copied(p, r) for e, b, k, p, r in zip(empty, blank, same, prompts, replies)]
                refusal = refusals.log_odds(cut)
                # a reply with a sentence clearly in another language than its main one is mixed, not wholly that language
                langs_of = [[langs[k] for k in np.flatnonzero(row)] for row in mixed]
                reply_lang = [",".join(x) if x else names[b] for x, b in zip(langs_of, best)]
                prompt_lang = [str(names[b]) for b in first]
            columns = [
                batch.column("row_id"), batch.column("doc_id"), batch.column("content_type"), blank, empty, refusal, copy, reply_lang, prompt_lang, conf,
                [len(r or "") for r in replies], [len((r or "").encode("utf-8", "replace")) for r in replies], [prompt_state(p) for p in prompts], ends, one, pair,
                np.bincount(cut.doc[cut.sentence], minlength=n), np.bincount(cut.doc[cut.closed & ~cut.code & (cut.last > cut.first)], minlength=n),
            ]
            columns = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _ARROW)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, f.type) for f in list(_ARROW)[-3:])], schema=_ARROW)
            if len(sums.keys) > HELD:
                yield from _counts(sums)
        yield from _counts(sums)

    return run


def _counts(sums: Sums) -> Iterator[pa.RecordBatch]:
    for b in sums.sent(BUCKETS):
        yield pa.RecordBatch.from_arrays([*(pa.nulls(b.num_rows, f.type) for f in list(_ARROW)[:-3]), *b.columns], schema=_ARROW)
