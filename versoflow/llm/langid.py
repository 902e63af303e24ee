"""Problem 5: language of each text and of each stretch of a text, with a confidence; wrong and missing labels.

Method: interpolated Kneser-Ney character models, one a language, in sorted hash arrays. Each sentence gets the
language of lowest cross-entropy for its length; sentences whose best cross-entropy lies above a limit calibrated
on the training sentences, and lines that are headings, tables, code or references, are rejected; unbroken runs of
letters say nothing. Sentences of under three words or eight letters count where a text has no longer one.

Defined results: null, empty and letterless texts have no language (``langs`` empty, status ``none``); a text
without any language is never listed as a case. Ties go to the language first in the alphabet. Repeated rows
count each for itself. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versoflow.llm.charlm import KneserNey, samples_by_language
from versoflow.llm.cutting import Cut, Rated, WordScores, slices

#: Rows of labelled sentences a language that the models are fitted on, at most.
MAX_SAMPLES = 2000
#: Nats by which a sentence must prefer another language before it leaves the text's main language.
STAY = 4.0
#: Nats by which a short sentence, of a text without longer ones, must prefer its language.
CLEAR = 3.0
#: Letters in a row, of Latin words and of Han and kana, from which they are an unbroken run: such a run says nothing, the
#: rest of its sentence does.
RUNS = (100, 300)

# Codes and names of the six languages in usual label styles, before any region.
LABELS = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "zh": ["zh", "zho", "chi", "cmn", "chinese", "中文", "汉语"],
    "ja": ["ja", "jpn", "jp", "japanese", "日本語", "日本语"],
}


def label_language(label: Column) -> Column:
    """Two-letter code that a label names in any usual style, else null."""
    head = F.lower(F.regexp_extract(F.trim(label), r"^([^\W_]+)", 1))
    known = F.create_map(*[F.lit(x) for lang, names in LABELS.items() for n in names for x in (n, lang)])
    return F.try_element_at(known, head)


def labelled_sentences(samples: DataFrame, glossary: DataFrame | None = None, limit: int = MAX_SAMPLES) -> list[tuple[str, str]]:
    """At most ``limit`` labelled sentences and terms a language, brought to the driver to fit the models on."""
    rows = samples.select("lang", F.col("text").alias("t"), F.lit(0).alias("k"))
    if glossary is not None:
        for lang, text in (("source_lang", "term"), ("target_lang", "translation")):
            rows = rows.unionByName(glossary.select(F.col(lang).alias("lang"), F.trim(text).alias("t"), F.lit(1).alias("k")))
    rows = rows.where("lang is not null and trim(t) <> ''").distinct()
    from pyspark.sql import Window

    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("k", F.xxhash64("t"), "t")))
    return [(r.lang, r.t) for r in ranked.where(F.col("n") <= limit).orderBy("lang", "n").select("lang", "t").collect()]


_MARKER = re.compile(r"\s*\[(?:Translation )?Failed[^\]]*\]?\s*|.*Failed\]\s*")
_CODE = re.compile(r"\w\(|\w_\w|[={}]")


def readable(text: str | None) -> str | None:
    """The text without the fence that wraps it whole; null for the pipeline's failure markers."""
    if not text or text[-1:] == "]" and _MARKER.fullmatch(text):
        return None
    if text.startswith("```"):
        body = text[3:].rstrip().removesuffix("```")
        if "```" not in body and not _CODE.search(body):
            return body
    return text


class Detector:
    """Language decisions for batches of texts; built in each Python worker from the broadcast models."""

    def __init__(self, model: KneserNey, limits: dict[int, float]) -> None:
        self.model, self.limits = model, limits
        self.scores = WordScores(model)
        self.langs = np.array(model.langs)

    def decide(self, texts: list[str | None]) -> tuple[Cut, np.ndarray, np.ndarray, np.ndarray]:
        """Sentences, and for each: its language number or -1, total log-probabilities, letters."""
        cut = Cut([readable(t) for t in texts])
        rated = Rated(cut, self.scores, 1, RUNS)
        n_words = rated.words
        wide, latin, total = rated.wide, rated.latin, rated.total
        count = np.where(rated.is_wide, wide, latin)
        entropy = -total.max(axis=1, initial=-1e9) / np.maximum(count, 1)
        fits = ~cut.code & ~cut.table & ~cut.heading & (entropy <= np.where(rated.is_wide, self.limits[1], self.limits[0]))
        sound = fits & (n_words >= 3) & np.where(rated.is_wide, wide >= 5, latin >= 8)
        # short sentences that end with a mark speak for texts that have no longer one
        docs, size = cut.docs, len(self.langs)
        alone = np.bincount(cut.doc, sound, minlength=docs)[cut.doc] == 0
        clear = np.sort(total, axis=1)
        clear = clear[:, -1] - clear[:, -2] >= CLEAR if size > 1 else np.ones(len(total), dtype=bool)
        sound |= alone & fits & cut.closed & clear & (n_words >= 2) & (count >= 4)
        prior = np.stack([np.bincount(cut.doc[sound], total[sound, k], minlength=docs) for k in range(size)], axis=1)
        held = total.copy()
        held[np.arange(len(cut.doc)), prior.argmax(axis=1)[cut.doc]] += STAY
        return cut, np.where(sound, held.argmax(axis=1), -1), total, count


def calibrated_limits(model: KneserNey, rows: list[tuple[str, str]]) -> dict[int, float]:
    """Cross-entropy a letter above which a sentence is rejected, for Latin (0) and wide (1) scripts.

    Held-out: models fitted on the even sentences rate the odd ones; the limit is the largest value met, with room.
    """
    even = KneserNey(samples_by_language(rows[0::2]), model.order)
    odd = [r for r in rows[1::2] if len(r[1]) >= 12 and r[0] in even.langs]
    limits = {0: 3.6, 1: 12.0}
    if odd:
        d = Detector(even, {0: 1e9, 1: 1e9})
        s, lang, total, count = d.decide([t for _, t in odd])
        ok = (lang >= 0) & (count >= 8)
        value = -total.max(axis=1) / np.maximum(count, 1)
        wide = np.isin(d.langs[np.maximum(lang, 0)], ["zh", "ja"])
        for k, mask in ((0, ok & ~wide), (1, ok & wide)):
            if mask.sum() >= 20:
                limits[k] = float(np.quantile(value[mask], 0.995)) * 1.25
    return limits


def fit(spark: SparkSession, rows: list[tuple[str, str]]) -> tuple[KneserNey, dict[int, float]]:
    model = KneserNey(samples_by_language(rows))
    return model, calibrated_limits(model, rows)


RESULT = (
    "row_id bigint, field string, label string, langs array<string>, main string, confidence double, "
    "stretches array<struct<lang:string,first_no:int,last_no:int,confidence:double>>"
)


def _mapper(broadcast, fields: list[str], labels: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(*broadcast.value)
        schema = pa.schema([
            ("row_id", pa.int64()), ("field", pa.string()), ("label", pa.string()), ("langs", pa.list_(pa.string())),
            ("main", pa.string()), ("confidence", pa.float64()),
            ("stretches", pa.list_(pa.struct([("lang", pa.string()), ("first_no", pa.int32()), ("last_no", pa.int32()), ("confidence", pa.float64())]))),
        ])
        for batch, columns in slices(batches, tuple(fields)):
            rows = batch.column("row_id")
            for field, label, texts in zip(fields, labels, columns):
                s, lang, total, count = detector.decide(texts)
                langs, mains, confidences, stretches = _per_text(detector, s, lang, total)
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array([field] * len(texts)), batch.column(label).cast(pa.string()), pa.array(langs, type=schema.field("langs").type),
                     pa.array(mains, type=pa.string()), pa.array(confidences, type=pa.float64()), pa.array(stretches, type=schema.field("stretches").type)],
                    schema=schema,
                )

    return run


def _confidence(total: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Posterior of the chosen language under even priors; nats are shrunk, since characters aren't independent."""
    z = (total - total.max(axis=1, keepdims=True)) * 0.5
    e = np.exp(np.maximum(z, -60))
    return e[np.arange(len(lang)), lang] / e.sum(axis=1)


def _per_text(detector: Detector, s: Cut, lang: np.ndarray, total: np.ndarray):
    docs, size = s.docs, len(detector.langs)
    sound = lang >= 0
    counts = np.bincount(s.doc[sound] * size + lang[sound], minlength=docs * size)[: docs * size].reshape(docs, size)
    sums = np.stack([np.bincount(s.doc[sound], total[sound, k], minlength=docs)[:docs] for k in range(size)], axis=1)
    main = np.where(counts.sum(axis=1) > 0, counts.argmax(axis=1), -1)
    conf = _confidence(sums, np.maximum(main, 0))
    names = [str(x) for x in detector.langs]
    langs = [[] if m < 0 else [names[m]] for m in main]
    stretches: list = [None] * docs
    several = np.flatnonzero((counts > 0).sum(axis=1) > 1)
    if len(several):
        first = np.searchsorted(s.doc, several)
        last = np.searchsorted(s.doc, several, side="right")
        share = _confidence(total, np.maximum(lang, 0))
        for d, a, b in zip(several, first, last):
            langs[d] = [names[k] for k in np.flatnonzero(counts[d])]
            conf[d] *= counts[d].max() / counts[d].sum()
            stretches[d] = _stretches(s.number[a:b], lang[a:b], share[a:b], names)
    return langs, [None if m < 0 else names[m] for m in main], np.where(main < 0, 0.0, conf), stretches


def _stretches(number: np.ndarray, lang: np.ndarray, share: np.ndarray, names: list[str]) -> list[dict]:
    """Runs of sentences of one language, numbered by the counting rule; rejected sentences join the run before."""
    out: list[dict] = []
    for no, k, c in zip(number.tolist(), lang.tolist(), share.tolist()):
        if k < 0:
            continue
        if out and out[-1]["lang"] == names[k]:
            out[-1]["last_no"], out[-1]["confidence"] = no, min(out[-1]["confidence"], c)
        else:
            out.append({"lang": names[k], "first_no": no, "last_no": no, "confidence": c})
    return out


def detect_languages(
    segments: DataFrame,
    samples: DataFrame,
    glossary: DataFrame | None = None,
    fields: tuple[str, ...] = ("original_text", "translated_text"),
    labels: tuple[str, ...] = ("original_lang", "translated_lang"),
) -> DataFrame:
    """One row for each row and field: languages used, main language, confidence, stretches, and the label's state.

    ``status`` is ``none`` (no language), ``right``, ``missing`` (names none of the six), ``wrong`` or ``several``.
    One narrow Python stage, no shuffle: the models (a few hundred KB, bounded by MAX_SAMPLES) are broadcast.
    """
    spark = segments.sparkSession
    model = spark.sparkContext.broadcast(fit(spark, labelled_sentences(samples, glossary)))
    cut = segments.select(F.col("row_id").cast("long").alias("row_id"), *fields, *labels)
    found = cut.mapInArrow(_mapper(model, list(fields), list(labels)), RESULT)
    named = label_language(F.col("label"))
    status = (
        F.when(F.size("langs") == 0, "none")
        .when(F.size("langs") > 1, "several")
        .when(named.isNull(), "missing")
        .when(named == F.col("langs")[0], "right")
        .otherwise("wrong")
    )
    return found.withColumn("label_lang", named).withColumn("status", status)


def found(segments: DataFrame, samples: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Texts whose label is missing or wrong, or that have several languages: a row for each language used."""
    cases = detect_languages(segments, samples, glossary).where(F.col("status").isin("missing", "wrong", "several"))
    return cases.select("row_id", "field", F.explode("langs").alias("lang"))
