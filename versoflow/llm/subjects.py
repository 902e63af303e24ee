"""Problem 8: subject areas of documents, and the share of each subject in the corpus.

Method: latent Dirichlet topics are fitted over all documents by distributed batch updates (zero-order collapsed
variational inference): workers share each document's words among the topics by the topics' word probabilities and
the document's proportions, and the expected counts are summed over the cluster as sparse sums of (word, topic). Each
subject's topic starts from the words that its labelled documents over-use, the topics of everyday words from all others;
fitting moves words between them by the documents that they are in. After it, the top terms of every
topic are inspected: it is mapped to the subject whose labelled documents use them most, or to none. A document's
proportion of a subject is the share of its units (sentences, lines, list entries) that have a word which the document's
topic proportions give to a topic of the subject; the subject is assigned above a cut calibrated on the labelled documents.

Labels may be wrong: they only start the topics, name them, and calibrate one number, from at most LABELLED of them.
Terms of few documents or few books are left out, as names are; a document without a book counts as a book of its own.
Words are numbered by 32 bits of a hash; the vocabulary is broadcast, and bounded by TERMS: beyond, the terms of the
fewest documents have no topic.

Defined results: null, empty and wordless texts have no subject. Repeated documents count each for itself; labels of
unknown documents, unknown subjects and null labels are ignored; repeated labels count once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoflow.llm.cutting import HAN, KATAKANA, LATIN, Cut, distinct, paired, slices
from versoflow.llm.sampling import by_hash
from versoflow.llm.sums import Sums, pack, total_of, unpack
from versoflow.llm.textkit import sentences
from versoflow.session import materialize

#: Bounds: labelled documents used, terms of the vocabulary.
LABELLED, TERMS = 40_000, 500_000
#: Topics beside those that start from the subjects; rounds over the corpus; rounds within a document.
BACKGROUND, ROUNDS, INNER = 6, 8, 4
#: Dirichlet priors of documents' topics and of topics' words.
ALPHA, BETA = 0.1, 0.01
#: A term must be in at least so many documents and, about, in this share of all books (and in two).
LEAST_DOCS, BOOK_SHARE = 4, 0.006
#: Slots that books and languages are counted in, by hash.
BOOK_SLOTS, LANG_SLOTS = 1024, 16
#: Standard deviations by which a word's labelled count must exceed what is expected to start a subject's topic.
CLEAR = 2.5
#: A topic is a subject's if its top terms fall to that subject's labelled documents by at least this share.
PURE = 0.45
#: Least probability that a word is of a subject's topics to make its unit one of the subject.
SURE = 0.5
TOP_TERMS = 40
#: Cut for a document's share of a subject without enough labels, and the range in which it is calibrated.
CUTS = (0.2, 0.18, 0.25)
#: Buckets of the sums, expected counts' grain, and sums that a worker holds.
BUCKETS, GRAIN, HELD = 64, 64, 3_000_000

_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>")
_JSON_END = re.compile(r'"\s*[,}\]]')
_JSON_KEY = re.compile(r'"\w+"\s*:\s*(?:-?\d+(?:\.\d+)?\s*,?)?')
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_WRAPPED = re.compile(r"(?<=[^\s.!?…。！？:：>*|#-])-?\n(?=[^\W\d_][^\n]*)")


def prepared(text: str | None) -> str | None:
    """The text with its units as sentences: wrapped lines joined, markup and JSON taken apart."""
    if not text:
        return text
    head = text.lstrip()[:8]
    if head.startswith(("[", "{", "```")) or '"translation"' in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
        text = _JSON_KEY.sub("\n", _JSON_END.sub('"\n', text)).replace("```json", "\n")
    if "<" in text:
        text = _MARKUP.sub("\n", text)
    if "\n" in text and _is_wrapped(text):
        text = re.sub(r"(?<=\w)-\n(?=\w)", "", text)
        text = _WRAPPED.sub(" ", text)
    return text


def units(text: str | None) -> list[str]:
    """The sentences, lines and list entries of a document."""
    return sentences(prepared(text))


def _is_wrapped(text: str) -> bool:
    """Whether lines end at a fixed width: most of those that others follow end without a mark, at like lengths."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 3:
        return False
    opened = [x for x in lines[:-1] if x.rstrip()[-1:] not in ".!?…。！？:：>*|" and not x.startswith(("-", "#", "|", ">"))]
    return len(opened) >= 0.4 * (len(lines) - 1) and max(map(len, opened)) <= 100 and sum(map(len, opened)) / len(opened) > 30


class Units:
    """Terms of a batch of documents: ``doc``, ``unit`` (numbered through the batch) and ``term`` of each, once a unit; and
    the number of units of each document. Terms are Latin words of three letters or more, runs of two katakana or more,
    pairs of neighbouring Han characters and single ones that stand alone."""

    def __init__(self, texts: list[str | None]) -> None:
        cut = Cut([prepared(t) for t in texts], han=1)
        han = cut.script == HAN
        joins = han[1:] & han[:-1] & (cut.begin[1:] == cut.stop[:-1])
        before, after = np.concatenate(([False], joins)), np.concatenate((joins, [False]))[: len(han)]
        key = cut.key.copy()
        at = np.flatnonzero(after)
        key[at] = paired(cut.key[at], cut.key[at + 1])
        length = cut.stop - cut.begin
        keep = np.where(han, after | ~before[: len(han)], ((cut.script == LATIN) & (length >= 3)) | ((cut.script == KATAKANA) & (length >= 2)))
        # units with letters; those without terms count too
        live = np.flatnonzero(cut.last > cut.first)
        number = np.full(len(cut.start), -1)
        number[live] = np.arange(len(live))
        self.units = np.bincount(cut.doc[live], minlength=cut.docs)
        once = distinct((number[cut.sentence[keep]].astype(np.uint64) << np.uint64(32)) | (key[keep] >> np.uint64(32)))
        self.unit, self.term = (once >> np.uint64(32)).astype(np.int64), once & np.uint64(0xFFFFFFFF)
        self.doc = np.repeat(np.arange(cut.docs), self.units)[self.unit]


ENCODED = "doc_ids binary, units binary, unit binary, term binary, vocabulary binary, bucket int, keys binary, sums binary"
_ARROW = pa.schema([(n, pa.int32() if t == "int" else pa.binary()) for n, t in (x.split() for x in ENCODED.split(", "))])


def _rows(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW)


def _encode_mapper(shared):
    """Slices of documents as arrays; and for each term how many documents have it, by slots of books and of languages, and
    how many labelled documents of each subject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sums = Sums()
        sent = lambda: (_rows({c: b.column(c) for c in b.schema.names}) for b in sums.sent(BUCKETS))
        for batch, (texts,) in slices(batches, ("text",)):
            u = Units(texts)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            vocabulary = distinct(u.term)
            local = np.searchsorted(vocabulary, u.term)
            once = distinct(u.doc * max(1, len(vocabulary)) + local)
            doc, term = once // max(1, len(vocabulary)), vocabulary[once % max(1, len(vocabulary))] << np.uint64(32)
            slot = np.array([_slot(b, d) + (BOOK_SLOTS * (zlib.crc32(g.encode()) % LANG_SLOTS) if g else BOOK_SLOTS * LANG_SLOTS) for b, d, g in zip(
                batch.column("book_id").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist())], dtype=np.uint64)
            sums.add(term | slot[doc])
            mine = [(k, s) for k, d in enumerate(ids.tolist()) for s in known.get(d, ())]
            for k, s in mine:
                a, b = np.searchsorted(doc, (k, k + 1))
                sums.add(term[a:b] | np.uint64((1 << 24) + s))
            packed = {"doc_ids": (ids, np.int64), "units": (u.units, np.int32), "unit": (np.diff(u.unit, prepend=0), np.int32), "term": (local, np.int32), "vocabulary": (vocabulary, np.uint32)}
            yield _rows({n: pa.array([pack(a, t)], pa.binary()) for n, (a, t) in packed.items()})
            if len(sums.keys) > HELD:
                yield from sent()
        yield from sent()

    return run


def _slot(book: int | None, doc: int | None) -> int:
    """Slot of a document's book; one without a book has its own."""
    return zlib.crc32((f"b{book}" if book is not None else f"d{doc}").encode()) % BOOK_SLOTS


def _statistics(n_subjects: int, least_spread: float, most_docs: float):
    """term, docs, lang, labelled counts of the terms of a bucket that are in enough documents and books."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, sums = total_of(zip(pdf["keys"], pdf["sums"]))
        term, low = keys >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, dtype=np.int64)
        of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(term))))
        plain, size = low < 1 << 24, len(head)
        docs = np.bincount(of[plain], sums[plain], minlength=size)
        slots = distinct(of[plain] * BOOK_SLOTS + low[plain] % BOOK_SLOTS) // BOOK_SLOTS
        filled = np.minimum(np.bincount(slots, minlength=size), BOOK_SLOTS - 1)
        spread = -BOOK_SLOTS * np.log(1 - filled / BOOK_SLOTS)  # books, by linear counting
        lang = np.bincount(of[plain] * (LANG_SLOTS + 1) + low[plain] // BOOK_SLOTS, sums[plain], minlength=size * (LANG_SLOTS + 1)).reshape(size, -1)
        labelled = np.bincount(of[~plain] * max(1, n_subjects) + low[~plain] - (1 << 24), sums[~plain], minlength=size * max(1, n_subjects)).reshape(size, -1)
        keep = (docs >= LEAST_DOCS) & (docs <= most_docs) & (spread >= least_spread)
        return pd.DataFrame({
            "term": term[head][keep].astype(np.int64), "docs": docs[keep].astype(np.int64), "lang": lang[keep][:, :LANG_SLOTS].argmax(axis=1).astype(np.int64),
            "labelled": pd.Series(list(labelled[keep].astype(np.int64)), dtype=object),
        })

    return run


class Batch:
    """A slice of encoded documents, with the terms of the vocabulary only (``word``: their numbers in it)."""

    def __init__(self, row: dict[str, bytes], vocabulary: np.ndarray) -> None:
        get = lambda n, t: unpack(row[n], t)
        self.ids, self.units = get("doc_ids", np.int64), get("units", np.int32).astype(np.int64)
        unit, local, held = np.cumsum(get("unit", np.int32), dtype=np.int64), get("term", np.int32), get("vocabulary", np.uint32)
        at = np.minimum(np.searchsorted(vocabulary, held), max(0, len(vocabulary) - 1))
        number = np.where(vocabulary[at] == held, at, -1) if len(vocabulary) else np.full(len(held), -1)
        word = number[local] if len(local) else np.zeros(0, dtype=np.int64)
        keep = word >= 0
        self.unit, self.word = unit[keep], word[keep]
        self.owner = np.repeat(np.arange(len(self.units)), self.units)

    def counted(self, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, word and number of units of every word of every document, by document."""
        key = np.sort(self.owner[self.unit] * max(1, terms) + self.word)
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else key
        return key[head] // max(1, terms), key[head] % max(1, terms), np.diff(np.append(head, len(key)))


def _batches(rows: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[Batch]:
    for part in rows:
        for row in part.to_pylist():
            yield Batch(row, vocabulary)


def infer(doc: np.ndarray, word: np.ndarray, count: np.ndarray, docs: int, phi: np.ndarray, rounds: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """Topic shares of each word (a column a word), with the documents' proportions found by fixed-point rounds; and these."""
    like = phi[:, word]
    head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else doc
    n = np.diff(np.append(head, len(doc)))
    count = count.astype(np.float32)
    share = like / np.maximum(like.sum(axis=0), 1e-30)
    theta = np.zeros((len(phi), len(head)), dtype=np.float32)
    for _ in range(rounds):
        theta = np.add.reduceat(share * count, head, axis=1) + np.float32(ALPHA) if len(head) else theta
        share = like * np.repeat(theta, n, axis=1)
        share /= np.maximum(share.sum(axis=0), 1e-30)
    full = np.full((len(phi), docs), ALPHA, dtype=np.float32)
    full[:, doc[head]] = theta
    return share, full


def _update_mapper(model):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, phi = model.value
        sums = np.zeros((len(phi), len(vocabulary)))
        for batch in _batches(rows, vocabulary):
            doc, word, count = batch.counted(len(vocabulary))
            if len(word):
                share, _ = infer(doc, word, count, len(batch.units), phi)
                share *= count
                used = distinct(word)
                at = np.searchsorted(used, word)
                for k in range(len(phi)):
                    sums[k, used] += np.bincount(at, share[k], minlength=len(used))
        units = np.round(sums * GRAIN).astype(np.int64)
        topic, word = np.nonzero(units)
        total = Sums()
        total.add(*_ascending((word.astype(np.uint64) << np.uint64(32)) | topic.astype(np.uint64), units[topic, word]))
        yield from total.sent(BUCKETS)

    return run


def _ascending(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def _topic_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, sums = total_of(zip(pdf["keys"], pdf["sums"]))
    return pd.DataFrame({"word": (keys >> np.uint64(32)).astype(np.int64), "topic": (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), "n": sums / GRAIN})


def _normalised(sums: np.ndarray) -> np.ndarray:
    sums = sums + BETA
    return (sums / sums.sum(axis=1, keepdims=True)).astype(np.float32)


class Model:
    """Fitted topics: terms, word probabilities, the subject of each topic (-1 none), and the weights of terms in the
    inspection of the top ones."""

    def __init__(self, terms: np.ndarray, phi: np.ndarray, subject: np.ndarray, names: list[str], weight: np.ndarray) -> None:
        self.terms, self.phi, self.subject, self.names, self.weight = terms, phi, subject, names, weight
        self.cut = CUTS[0]

    def top_terms(self, topic: int, n: int = 10) -> list[int]:
        return [int(self.terms[k]) for k in np.argsort(-self.phi[topic] * self.weight)[:n]]


def _starts(labelled: np.ndarray, language: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Words that the topics start from: for each subject the words that its labelled documents over-use beyond chance; for
    the topics of everyday words all others, with random weights by which they come apart.

    What is expected of a word goes by how the labelled words of its language fall to the subjects, since the labelled
    documents of a subject need not have the languages of the others.
    """
    s, v = labelled.shape
    expected = np.zeros_like(labelled)
    for k in np.unique(language):
        mine = labelled[:, language == k]
        expected[:, language == k] = mine.sum(axis=0) * ((mine.sum(axis=1) + 1) / (mine.sum() + s))[:, None]
    lift = (labelled + 0.02) / (expected + 0.02 * max(1, s))
    clear = (labelled - expected) / np.sqrt(np.maximum(expected, 0.25))
    strength = np.where((lift > 1.5) & (clear >= CLEAR) & (labelled >= 2), labelled * np.log(np.maximum(lift, 1.0)), 0.0)
    seeds = np.where(strength > 0, docs, 0.0)
    # everyday words of each language start in its own topics
    background = np.zeros((BACKGROUND, v))
    random = np.random.default_rng(7).gamma(2.0, 0.5, (BACKGROUND, v))
    background[:] = docs * random * (seeds.max(axis=0, initial=0) == 0)
    home = language % BACKGROUND
    background *= np.where(np.arange(BACKGROUND)[:, None] == home, 1.0, 0.05)
    return np.concatenate((seeds, background))


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame, dict[int, tuple[int, ...]]]:
    """The model, the encoded documents (in the shared folder), and the labels used."""
    spark = documents.sparkSession
    names = sorted(r.subject for r in subjects.where("subject is not null").select("subject").distinct().collect())  # configuration
    number = {s: k for k, s in enumerate(names)}
    some = labels.where("doc_id is not null and subject is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "subject").distinct()
    known: dict[int, tuple[int, ...]] = {}
    for r in by_hash(some, LABELLED, "doc_id", "subject").collect():
        if r.subject in number:
            known[r.doc_id] = (*known.get(r.doc_id, ()), number[r.subject])
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("book_id").cast("long").alias("book_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    both = materialize(docs.mapInArrow(_encode_mapper(spark.sparkContext.broadcast(known)), ENCODED))
    encoded = both.where("bucket is null").select("doc_ids", "units", "unit", "term", "vocabulary")
    size = docs.agg(F.count("*").alias("n"), F.approx_count_distinct(F.coalesce(F.col("book_id"), -1 - F.col("doc_id"))).alias("b")).first()
    n_docs, n_books = max(1, size.n), max(1, size.b)
    spread = min(0.5 * BOOK_SLOTS, max(1.5, BOOK_SHARE * n_books))
    statistics = _statistics(len(names), spread, 0.5 * n_docs)
    kept = both.where("bucket is not null").select("bucket", "keys", "sums").groupBy("bucket").applyInPandas(statistics, "term bigint, docs bigint, lang bigint, labelled array<bigint>")
    table = kept.orderBy(F.desc("docs"), "term").limit(TERMS).toPandas().sort_values("term")
    terms, v, s = table["term"].to_numpy().astype(np.uint32), len(table), len(names)
    labelled = np.array(table["labelled"].tolist(), dtype=float).reshape(v, max(1, s)).T[:s]
    docs_of = table["docs"].to_numpy(float)
    phi = _normalised(_starts(labelled, table["lang"].to_numpy(), docs_of)) if v else np.zeros((s + BACKGROUND, 0), dtype=np.float32)
    for _ in range(rounds if v else 0):
        current = spark.sparkContext.broadcast((terms, phi))
        sent = encoded.mapInArrow(_update_mapper(current), "bucket int, keys binary, sums binary")
        got = sent.groupBy("bucket").applyInPandas(_topic_sums, "word bigint, topic bigint, n double").toArrow()  # at most topics * TERMS sums
        sums = np.zeros(phi.shape)
        sums[got.column("topic").to_numpy(), got.column("word").to_numpy()] = got.column("n").to_numpy()
        phi = _normalised(sums)
        current.unpersist()
    # inspection of the top terms: which subject's labelled documents use them
    n_of = np.array([max(1, sum(k in x for x in known.values())) for k in range(s)], dtype=float)
    rate = (labelled + 0.02) / n_of[:, None]
    weight = np.log(n_docs / np.maximum(1.0, docs_of))
    share_of = rate / np.maximum(rate.sum(axis=0), 1e-9)
    subject = np.full(len(phi), -1)
    for t in range(len(phi) if s and v else 0):
        top = np.argsort(-phi[t] * weight)[:TOP_TERMS]
        votes = (share_of[:, top] * phi[t][top]).sum(axis=1) / max(1e-12, phi[t][top].sum())
        if votes.max() >= PURE:
            subject[t] = int(votes.argmax())
    return Model(terms, phi, subject, names, weight), encoded, known


def _assign_mapper(model):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        n = len(m.names)
        for batch in _batches(rows, m.terms):
            count = np.zeros((len(batch.units), n))
            if len(batch.word):
                doc, word, times = batch.counted(len(m.terms))
                share, _ = infer(doc, word, times, len(batch.units), m.phi)
                at = np.searchsorted(doc * len(m.terms) + word, batch.owner[batch.unit] * len(m.terms) + batch.word)
                for s in range(n):
                    hit = np.zeros(len(batch.owner), dtype=bool)
                    hit[batch.unit[(share[m.subject == s].sum(axis=0) >= SURE)[at]]] = True
                    count[:, s] = np.bincount(batch.owner[hit], minlength=len(batch.units))
            shares = count / np.maximum(1, batch.units)[:, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.ids), pa.array(batch.units, pa.int32()), pa.array(list(shares), pa.list_(pa.float64()))], ["doc_id", "n_units", "shares"]
            )

    return run


def _calibrated(shares: list[tuple[int, list[float]]], known: dict[int, tuple[int, ...]]) -> float:
    """The cut of best agreement with the labels; labels with gaps and mistakes blur it, so it stays near a quarter."""
    got = [(known[d], x) for d, x in shares if d in known]
    if len(got) < 50:
        return CUTS[0]
    best = (-1.0, 0.0, CUTS[0])
    for cut in np.arange(CUTS[1], CUTS[2] + 0.001, 0.01):
        right = wrong = missed = 0
        for labels, x in got:
            said = {k for k, v in enumerate(x) if v >= cut}
            right += len(said & set(labels))
            wrong += len(said - set(labels))
            missed += len(set(labels) - said)
        best = max(best, (2 * right / max(1, 2 * right + wrong + missed), -abs(float(cut) - CUTS[0]), float(cut)))
    return best[-1]


def shares(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Model]:
    """doc_id, n_units, share of the units of each subject (in the order of Model.names)."""
    spark = documents.sparkSession
    model, encoded, known = fit(documents, labels, subjects, rounds)
    shared = spark.sparkContext.broadcast(model)
    out = materialize(encoded.mapInArrow(_assign_mapper(shared), "doc_id bigint, n_units int, shares array<double>"))
    ids = spark.createDataFrame([(d,) for d in known] or [(-1,)], "doc_id bigint")
    seen = out.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "shares").limit(2 * LABELLED).collect()
    model.cut = _calibrated([(r.doc_id, r.shares) for r in seen], known)
    return out, model


def assign(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """doc_id, subject, and the share of the document's units that deal with it."""
    out, model = shares(documents, labels, subjects)
    if not model.names:
        return out.select("doc_id", F.lit(None).cast("string").alias("subject"), F.lit(0.0).alias("share")).where("false")
    names = F.array(*[F.lit(n) for n in model.names])
    each = out.select("doc_id", F.posexplode("shares").alias("k", "share"))
    return each.where(F.col("share") >= model.cut).select("doc_id", F.get(names, F.col("k")).alias("subject"), "share")


def found(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    return assign(documents, labels, subjects).select("doc_id", "subject")


def corpus_shares(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """For each subject: documents assigned, their share, and the share of all units of the corpus."""
    out, model = shares(documents, labels, subjects)
    names = F.array(*[F.lit(n) for n in model.names])
    total = out.agg(F.count("*").alias("n_docs"), F.sum("n_units").alias("n_units"))
    each = out.select("n_units", F.posexplode("shares").alias("k", "share")).groupBy("k").agg(
        F.count_if(F.col("share") >= model.cut).alias("docs"), F.sum(F.col("share") * F.col("n_units")).alias("units")
    )
    return each.crossJoin(F.broadcast(total)).select(  # one row
        F.get(names, F.col("k")).alias("subject"), "docs", (F.col("docs") / F.col("n_docs")).alias("doc_share"), (F.col("units") / F.col("n_units")).alias("unit_share")
    )
