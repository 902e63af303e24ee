"""Pairs of texts that may be alike, by short signatures: no text is sent.

Lossless. Three ways to be alike: one text lies within the other; the words are alike, of texts without CJK letters; the
characters are alike, if either has CJK letters. A text whose set of characters has more CJK ones than 1 - LIKE leaves
room for is like no text without them.

- Sets: tokens are in one order for both sides, rarest on the left first, and two sets more alike than LIKE share one of the
  first few of both (prefix filter). Sets meet by such a token and by their sizes, and are compared by 128 bits in which
  every token sets one: sets that differ in more bits than they may in tokens are not alike.
- Texts inside others: a text inside one of n characters and above LIKE of its length begins at most e = floor((1 - LIKE) n)
  behind its start, so the characters from e to n - e are in it whole. The longer text, at most 58 characters, is known by
  its length and these; the shorter by every length that the longer may have and its pieces that may be these.

A bit set of all signatures of the left side, of fixed size, goes to the workers, and what the right side has besides is
dropped where it is made. It has false hits only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least similarity, exclusive.
LIKE = 0.85
#: A text of this many characters or more is sought in no longer one.
SHORT = 50
#: Bits of the number of a bit, of the bit set of the left side's signatures; numbers of counts for the order of tokens.
BITS, PLACES = 26, 1 << 16
#: Characters that are looked at at a time.
SLICE_CHARS = 1_000_000
SIGNS = "id bigint, sig bigint, n int, lo bigint, hi bigint"

_MOST = int((SHORT - 1) / LIKE) + 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWER, _UNPOWER = (np.array([pow(b, k, 1 << 64) for k in range(_MOST + 1)], dtype=np.uint64) for b in (int(_BASE), pow(int(_BASE), -1, 1 << 64)))
#: Kinds of signatures: sets of words, of characters of two CJK texts, and of one with few of them and one without on
#: either side; the left text inside the right one and the reverse.
WORDS, WIDE, FEW_LEFT, FEW_RIGHT, LEFT_INSIDE, RIGHT_INSIDE = range(6)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _tagged(x: np.ndarray, kind: int, number: np.ndarray) -> np.ndarray:
    """Signatures of a kind, apart by a small number."""
    return _mix(x ^ _mix((number.astype(np.int64) * 8 + kind + 1).astype(np.uint64)))


class Sets:
    """Sets of tokens of some texts: ``row`` and ``hash`` of each token, in order of rows; ``n`` tokens a row."""

    def __init__(self, row: np.ndarray, code: np.ndarray, hashes: np.ndarray, rows: int) -> None:
        """Of tokens by row and code; ``hashes`` of the codes."""
        both = np.unique(row.astype(np.int64) * len(hashes) + code)
        self.row, code = np.divmod(both, max(len(hashes), 1))
        self.hash, self.n = hashes[code], np.bincount(self.row, minlength=rows)

    def bits(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits a row, of which every token sets one."""
        bit = (self.hash >> np.uint64(40)) & np.uint64(127)
        one = np.uint64(1) << (bit & np.uint64(63))
        out = []
        full = np.flatnonzero(self.n)
        begin = (np.cumsum(self.n) - self.n)[full]
        for half in (bit < 64, bit >= 64):
            word = np.zeros(len(self.n), dtype=np.uint64)
            if len(full):
                word[full] = np.bitwise_or.reduceat(np.where(half, one, np.uint64(0)), begin)
            out.append(word)
        return out[0], out[1]

    def firsts(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """row, hash of the first tokens of every set: n - ceil(LIKE n) + 1 of them."""
        order = np.lexsort((self.hash, counts[(self.hash & np.uint64(PLACES - 1)).astype(np.int64)], self.row))
        row, h = self.row[order], self.hash[order]
        rank = np.arange(len(row)) - (np.cumsum(self.n) - self.n)[row]
        keep = rank < self.n[row] - np.ceil(self.n[row] * LIKE - 1e-9) + 1
        return row[keep], h[keep]


class Texts:
    """Some normalised texts, with their words and characters."""

    def __init__(self, texts: list[str], lower: pa.Array) -> None:
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.char = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.row = np.repeat(np.arange(len(texts)), self.size)
        cjk = ((self.char >= 0x3040) & (self.char <= 0x30FF)) | ((self.char >= 0x4E00) & (self.char <= 0x9FFF))
        self.wide = np.bincount(self.row[cjk], minlength=len(texts)) > 0
        seen = self.char != 32
        known, code = np.unique(self.char[seen], return_inverse=True)
        self.characters = Sets(self.row[seen], code, _mix(known.astype(np.uint64) + np.uint64(1)), len(texts))
        of_cjk = Sets(self.row[cjk], self.char[cjk], _mix(np.arange(0xA000, dtype=np.uint64)), len(texts)).n
        self.few = self.wide & (of_cjk <= (1 - LIKE + 1e-9) * self.characters.n)
        parts = pc.split_pattern(lower, " ")
        words = pc.list_flatten(parts).dictionary_encode()
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        known = words.dictionary.to_numpy(zero_copy_only=False).astype(object)
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seen = (known != "")[code] if len(known) else np.zeros(0, dtype=bool)
        self.words = Sets(row[seen], code[seen], pd.util.hash_array(known, categorize=False) if len(known) else np.zeros(0, np.uint64), len(texts))

    def sets(self, left: bool) -> list[tuple[Sets, int, np.ndarray]]:
        """Sets, kind, and the rows that take part."""
        few_kind, plain_kind = (FEW_LEFT, FEW_RIGHT) if left else (FEW_RIGHT, FEW_LEFT)
        return [(self.words, WORDS, ~self.wide), (self.characters, WIDE, self.wide), (self.characters, few_kind, self.few), (self.characters, plain_kind, ~self.wide)]

    def insides(self, left: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """row, signature of texts that may lie within another and of those that may hold one."""
        short = np.flatnonzero(self.size <= _MOST)
        with np.errstate(over="ignore"):
            for m in np.unique(self.size[short]):
                rows = short[self.size[short] == m]
                value = _mix(self.char[self.begin[rows][:, None] + np.arange(m)].astype(np.uint64) + np.uint64(7)) * _POWER[:m]
                sums = np.concatenate((np.zeros((len(rows), 1), np.uint64), np.cumsum(value, axis=1, dtype=np.uint64)), axis=1)
                off = int(m * round(1 - LIKE, 9) + 1e-9)
                part = (sums[:, m - off] - sums[:, off]) * _UNPOWER[off]
                yield rows, _tagged(part, RIGHT_INSIDE if left else LEFT_INSIDE, np.full(len(rows), m))
                if m >= SHORT:
                    continue
                for n in range(m, int(m / LIKE) + 1):
                    off = int(n * round(1 - LIKE, 9) + 1e-9)
                    for p in range(max(0, off - (n - m)), min(off, m - (n - 2 * off)) + 1):
                        part = (sums[:, p + n - 2 * off] - sums[:, p]) * _UNPOWER[p]
                        yield rows, _tagged(part, LEFT_INSIDE if left else RIGHT_INSIDE, np.full(len(rows), n))


def _texts(batches: Iterator[pa.RecordBatch], least: int = 1) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    for batch in batches:
        batch = batch.filter(pc.greater_equal(pc.utf8_length(batch.column("s")), least))
        texts = batch.column("s").to_pylist()
        place = np.cumsum([len(t) for t in texts]) // SLICE_CHARS if texts else np.zeros(0)
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield batch.slice(a, b - a), Texts(texts[a:b], batch.column("lower").slice(a, b - a))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, PLACES), dtype=np.int64)
    for _, t in _texts(batches):
        for k, sets in enumerate((t.words, t.characters)):
            total[k] += np.bincount((sets.hash & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["place", "c"])


def _signing(counts, left: bool, least: int, bits=None):
    """Texts -> signatures; on the right, those that the left side may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {WORDS: counts.value[0]}
        held = None if bits is None else bits.value
        for batch, t in _texts(batches, least):
            ids = batch.column("id").to_numpy()
            none = np.zeros(0, np.uint64)
            out: list[tuple[np.ndarray, ...]] = []

            def add(row: np.ndarray, sig: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
                if held is not None:
                    at = sig >> np.uint64(64 - BITS)
                    hit = (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
                    row, sig = row[hit], sig[hit]
                if len(row):
                    out.append((ids[row], sig, n[row], lo[row], hi[row]))

            for sets, kind, who in t.sets(left):
                if not who.any():
                    continue
                row, h = sets.firsts(of.get(kind, counts.value[1]))
                row, h = row[who[row]], h[who[row]]
                lo, hi = sets.bits()
                step = np.floor(np.log(np.maximum(sets.n, 1)) / -np.log(LIKE)).astype(np.int64)
                for d in (-1, 0, 1) if left else (0,):
                    add(row, _tagged(h, kind, step[row] + d + 1), sets.n, lo, hi)
            inside = np.full(len(ids), -1), np.zeros(len(ids), np.uint64)
            for row, sig in t.insides(left):
                add(row, sig, inside[0], inside[1], inside[1])
            columns = [np.concatenate(c) for c in zip(*out)] if out else [none] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(y) for c, y in zip(columns, types)], ["id", "sig", "n", "lo", "hi"])

    return run


def near(left: DataFrame, right: DataFrame, least: int = 1) -> DataFrame:
    """``left_id``, ``right_id``: hashes of the texts (columns ``s``, normalised) of all pairs whose similarity may be above LIKE,
    each once; both have at least ``least`` characters. The left side, the smaller one, is read three times, the right side once."""
    sc = left.sparkSession.sparkContext
    left, right = (df.select(F.xxhash64("s").alias("id"), "s", F.lower("s").alias("lower")) for df in (left, right))
    rows = left.mapInArrow(_counting, "place bigint, c bigint").groupBy("place").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(2 * PLACES, dtype=np.int64)
    counts[rows.column("place").to_numpy()] = rows.column("c").to_numpy()
    counts = sc.broadcast(counts.reshape(2, PLACES))
    ours = left.mapInArrow(_signing(counts, True, least), SIGNS).distinct()
    at = ours.select(F.shiftrightunsigned("sig", 64 - BITS).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    held = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    held[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    theirs = right.mapInArrow(_signing(counts, False, least, sc.broadcast(held)), SIGNS)
    a, b = (df.select("sig", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "n", "lo", "hi")]) for x, df in (("left", ours), ("right", theirs)))
    apart = F.bit_count(F.col("left_lo").bitwiseXOR(F.col("right_lo"))) + F.bit_count(F.col("left_hi").bitwiseXOR(F.col("right_hi")))
    n, m = F.col("left_n"), F.col("right_n")
    # two sets with at least LIKE of their union in common differ in at most (1 - LIKE) / (1 + LIKE) of the sum of their sizes
    like = (F.least(n, m) >= F.ceil(F.lit(LIKE - 1e-9) * F.greatest(n, m))) & (apart <= (n + m) * F.lit((1 - LIKE) / (1 + LIKE)) + F.lit(1e-6))
    return a.join(b, "sig").where((n < 0) | like).select("left_id", "right_id").distinct()
