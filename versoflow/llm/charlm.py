"""Character models of languages over tokens: interpolated Kneser-Ney and naive Bayes.

Both are trained on the driver from a bounded sample of labelled sentences, are a few hundred KB, and give a
vector with one log-probability per language for a token. Statistics are kept in hash arrays sorted by key and
read with binary search. ``TokenScores`` keeps the vectors of the tokens met so far, since tokens repeat.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

from versoflow.llm.textkit import FIRST_WORD, Vocabulary, token_ids

_P = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
START, STOP = 2, 3


def _windows(tokens: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all tokens with START before and STOP behind; token number and place of each."""
    text = "".join(f"\x02{t}\x03" for t in tokens)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.cumsum(points == START) - 1
    begins = np.flatnonzero(points == START)
    place = np.arange(len(points)) - begins[owner]
    return points, owner, place


def _hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the window of n code points that ends at each place, n = 0..order."""
    out = [np.zeros(len(points), dtype=np.uint64)]
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(order):
            shifted = np.zeros(len(points), dtype=np.uint64)
            shifted[n:] = points[: max(0, len(points) - n)] + np.uint64(1)
            out.append(out[-1] + shifted * power)
            power = power * _P
    return out


def _key(window: np.ndarray, n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (window + np.uint64(n * 7919 + salt * 104729 + 1)) * _MIX
        return (x ^ (x >> np.uint64(29))) * _MIX


class HashRows:
    """Sorted hash array: keys with a row of values each, one a language; absent keys give zeros."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rows = np.concatenate((rows[order].astype(np.float64), np.zeros((1, rows.shape[1]))))

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return self.rows[np.zeros(len(keys), dtype=np.int64)]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.rows[np.where(self.keys[at] == keys, at, len(self.keys))]


def script_class(points: np.ndarray) -> np.ndarray:
    """0 end of token, 1 Latin and other letters, 2 Han, 3 kana."""
    han = ((points >= 0x3400) & (points <= 0x9FFF)) | ((points >= 0xF900) & (points <= 0xFAFF)) | (points == 0x3005) | (points == 0x3006)
    kana = ((points >= 0x3040) & (points <= 0x30FF)) | ((points >= 0xFF66) & (points <= 0xFF9F))
    return np.where(points == STOP, 0, np.where(han, 2, np.where(kana, 3, 1)))


#: Supposed number of characters of each class, over which unseen characters are spread evenly.
_CLASS_SIZE = np.array([1, 200, 6000, 180])


def _class_shares(points: np.ndarray) -> np.ndarray:
    seen = np.bincount(script_class(points[points != START]), minlength=4) + 0.002 * max(1, len(points))
    return seen / seen.sum()


class KneserNey:
    """Interpolated Kneser-Ney over the characters of tokens, one model a language."""

    def __init__(self, samples: dict[str, list[str]], order: int = 5) -> None:
        self.langs, self.order = sorted(samples), order
        self.base = []
        probs: list[tuple[int, np.ndarray, np.ndarray]] = []
        backs: list[tuple[int, np.ndarray, np.ndarray]] = []
        for k, lang in enumerate(self.langs):
            points, _, place = _windows(samples[lang], order)
            self.base.append(_class_shares(points))
            text = [int(x) for x in points]
            counts: list[Counter] = [Counter() for _ in range(order + 1)]
            for i, at in enumerate(place):
                for n in range(1, min(order, at + 1) + 1):
                    if at:
                        counts[n][tuple(text[i - n + 1 : i + 1])] += 1
            for n in range(order, 0, -1):
                if n < order:  # continuation counts: in how many ways the n-gram is preceded
                    kinds = Counter(g[1:] for g in counts[n + 1])
                    used = {g: kinds[g] if g in kinds and g[0] != START else c for g, c in counts[n].items()}
                else:
                    used = counts[n]
                ones, twos = sum(c == 1 for c in used.values()), sum(c == 2 for c in used.values())
                discount = min(0.9, max(0.4, ones / (ones + 2 * twos))) if ones else 0.5
                total, kinds_after = defaultdict(float), Counter()
                for g, c in used.items():
                    total[g[:-1]] += c
                    kinds_after[g[:-1]] += 1
                for grams, into in (
                    ({g: max(0.0, c - discount) / total[g[:-1]] for g, c in used.items()}, probs),
                    ({c: discount * kinds_after[c] / total[c] for c in total}, backs),
                ):
                    if grams:
                        size = len(next(iter(grams)))
                        block = np.array(list(grams), dtype=np.uint64).reshape(len(grams), size)
                        window = np.zeros(len(grams), dtype=np.uint64)
                        power = np.uint64(1)
                        with np.errstate(over="ignore"):
                            for j in range(size - 1, -1, -1):
                                window = window + (block[:, j] + np.uint64(1)) * power
                                power = power * _P
                        into.append((k, _key(window, n, 0), np.array(list(grams.values()))))
        self.prob = self._rows(probs)
        self.back = self._rows([(k, keys, values - 1.0) for k, keys, values in backs])  # absent contexts give one
        self.base = np.array(self.base)

    def _rows(self, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> HashRows:
        keys = np.unique(np.concatenate([g for _, g, _ in parts]))
        rows = np.zeros((len(keys), len(self.langs)))
        for k, grams, values in parts:
            rows[np.searchsorted(keys, grams), k] = values
        return HashRows(keys, rows)

    def score(self, tokens: list[str]) -> np.ndarray:
        points, owner, place = _windows(tokens, self.order)
        windows = _hashes(points, self.order)
        kinds = script_class(points)
        p = self.base.T[kinds] / _CLASS_SIZE[kinds][:, None]
        for n in range(1, self.order + 1):
            fits = np.flatnonzero(place >= n - 1)
            context = windows[n - 1][fits - 1] if n > 1 else np.zeros(len(fits), dtype=np.uint64)
            p[fits] = self.prob.get(_key(windows[n][fits], n, 0)) + (1.0 + self.back.get(_key(context, n, 0))) * p[fits]
        return _token_sums(np.log(p), owner, place, len(tokens))


class NaiveBayes:
    """Multinomial naive Bayes over the character n-grams of tokens, and the script of each character."""

    def __init__(self, samples: dict[str, list[str]], order: int = 4, alpha: float = 0.05) -> None:
        self.langs, self.order = sorted(samples), order
        met: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
        scripts = []
        for lang in self.langs:
            points, _, place = _windows(samples[lang], order)
            scripts.append(np.log(_class_shares(points)))
            windows = _hashes(points, order)
            for n in range(1, order + 1):
                grams, counts = np.unique(windows[n][(place >= n - 1) & (place > 0)], return_counts=True)
                met[n].append((_key(grams, n, 100), counts))
        keys, rows = [], []
        self.unseen = np.zeros((order + 1, len(self.langs)))
        for n in range(1, order + 1):
            union = np.unique(np.concatenate([g for g, _ in met[n]]))
            values = np.empty((len(union), len(self.langs)))
            for k, (grams, counts) in enumerate(met[n]):
                size = counts.sum() + alpha * 20000
                self.unseen[n, k] = np.log(alpha / size)
                values[:, k] = self.unseen[n, k]
                values[np.searchsorted(union, grams), k] = np.log((counts + alpha) / size)
            keys.append(union)
            rows.append(values - self.unseen[n])
        self.table = HashRows(np.concatenate(keys), np.concatenate(rows))
        self.scripts = np.array(scripts)

    def score(self, tokens: list[str]) -> np.ndarray:
        points, owner, place = _windows(tokens, self.order)
        windows = _hashes(points, self.order)
        total = self.scripts.T[script_class(points)]
        for n in range(1, self.order + 1):
            fits = np.flatnonzero((place >= n - 1) & (place > 0))
            total[fits] += (self.table.get(_key(windows[n][fits], n, 100)) + self.unseen[n]) / self.order
        return _token_sums(total, owner, place, len(tokens))


def _token_sums(values: np.ndarray, owner: np.ndarray, place: np.ndarray, tokens: int) -> np.ndarray:
    live = place > 0
    return np.stack([np.bincount(owner[live], values[live, k], minlength=tokens) for k in range(values.shape[1])], axis=1)


class TokenScores:
    """Vectors of tokens by id, computed once per distinct token. ``limit`` bounds the memory of the cache."""

    def __init__(self, model: KneserNey | NaiveBayes, limit: int = 400_000, pattern=None) -> None:
        self.model, self.limit = model, limit
        self.pattern = {} if pattern is None else {"pattern": pattern}
        self._empty()

    def _empty(self) -> None:
        self.vocabulary = Vocabulary()
        langs = len(self.model.langs)
        self.known = FIRST_WORD
        self.scores = np.zeros((4096, langs))
        self.letters = np.zeros(4096)
        self.script = np.zeros(4096, dtype=np.int8)

    def ids(self, texts: list[str | None]) -> np.ndarray:
        if len(self.vocabulary) > self.limit:
            self._empty()
        ids = token_ids(texts, self.vocabulary, **self.pattern)
        self._fill()
        return ids

    def _fill(self) -> None:
        size = FIRST_WORD + len(self.vocabulary.words)
        if size > len(self.letters):
            grow = lambda a: np.concatenate((a, np.zeros((max(size, 2 * len(a)) - len(a), *a.shape[1:]), dtype=a.dtype)))
            self.scores, self.letters, self.script = grow(self.scores), grow(self.letters), grow(self.script)
        new = self.vocabulary.words[self.known - FIRST_WORD :]
        if new:
            numbers = np.array([w[0].isdigit() for w in new])  # these say nothing about a language
            self.scores[self.known : size] = np.where(numbers[:, None], 0.0, self.model.score(new))
            self.letters[self.known : size] = np.where(numbers, 0, [len(w) for w in new])
            self.script[self.known : size] = script_class(np.array([ord(w[0]) for w in new]))
            self.known = size


def samples_by_language(rows: list, alphabet: Vocabulary | None = None) -> dict[str, list[str]]:
    """(lang, text) rows -> language -> tokens. Rows with a null in either place are left out."""
    from versoflow.llm.textkit import _KIND, _TOKEN
    import unicodedata

    out: dict[str, list[str]] = {}
    for lang, text in rows:
        if lang and text:
            out.setdefault(lang, []).extend(t for t in _TOKEN.findall(unicodedata.normalize("NFC", text).lower()) if t[0] not in _KIND)
    return {k: v for k, v in out.items() if v}
