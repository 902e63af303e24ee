"""Problem 4: texts cut off by field limits or in transfer, and how often each source cuts.

Method: for each source a log-normal length distribution is fitted by maximum likelihood, values at a candidate
limit counting as right-censored there. A value's censoring posterior at the candidate limits is its prior of being
cut; values elsewhere have the rate of cuts in transfer. The prior is combined with evidence from the ending: the state
of the text's end beside that of its original's, and the end-of-text likelihood of its last words, an interpolated
word and word-pair model of where sentences end, counted over the whole corpus. How much each ending says, and the rate
in transfer, are fitted by expectation-maximisation over all rows, started from supposed odds.

Defined results: null, blank and marker texts are never cut. Rows without a book form a source of their own
(``service`` null). Repeated rows count each for itself. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoflow.llm import refusal
from versoflow.llm import replies as R
from versoflow.llm.charlm import NaiveBayes, samples_by_language
from versoflow.llm.langid import labelled_sentences
from versoflow.llm.sums import total_of
from versoflow.session import materialize

#: Share of cut values supposed before any evidence.
PRIOR = 0.05
#: A value may exceed its limit by so many units (a closing quote, a broken character).
SLACK = 3
#: Weight of the model of fewer words in that of more, in occurrences.
BACK = 0.5
#: Bounds between the classes of log-likelihood ratios of last words; the last class is of words met nowhere else.
LEVELS = (-2.0, -0.5, 0.5, 2.0, 6.0)
#: Log-odds of a cut that are supposed of each class.
SUPPOSED = (-3.0, -1.0, 0.0, 1.5, 3.0, 6.0, 3.4)
#: Occurrences that the supposed odds of an ending count for; rounds of fitting; width of a class of priors.
TRUST, ROUNDS, WIDTH = 200.0, 30, 0.5
#: Asked words and pairs that are broadcast to prune counts early (8 bytes each); beyond, the join alone does it.
HELD_WORDS = 3_000_000

LIMITS = "service string, unit string, limit int, n_at bigint, n_expected double, log_odds double"


def reply_features(segments: DataFrame, samples: DataFrame, glossary: DataFrame | None, whole: bool) -> DataFrame:
    """The features of all rows and the counts of words, in the shared folder: they are read several times."""
    spark = segments.sparkSession
    sentences = labelled_sentences(samples, glossary)
    model = NaiveBayes(samples_by_language(sentences))
    weights = refusal.fit(segments, sentences, lambda texts: _languages(model, texts)) if whole else (np.zeros(0, dtype=np.uint64), np.zeros(0))
    broadcast = spark.sparkContext.broadcast((model, weights))
    cut = segments.select(
        F.col("row_id").cast("long").alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("content_type").cast("string").alias("content_type"),
        F.col("original_text").alias("prompt"), F.col("translated_text").alias("reply"),
    )
    return materialize(cut.mapInArrow(R.mapper(broadcast, whole), R.FEATURES))


def _languages(model: NaiveBayes, texts: list[str]) -> list[str]:
    return [model.langs[k] if k >= 0 else "" for k in R.Posteriors(model).of(texts)[1]]


def with_books(features: DataFrame, books: DataFrame) -> DataFrame:
    """Rows of features with their book's service and target language; features are narrow, so the shuffle is."""
    kept = books.groupBy("doc_id").agg(F.min("service").alias("service"), F.min("target_lang").alias("target_lang"))
    return features.where("bucket is null").drop("bucket", "keys", "sums").join(kept, "doc_id", "left")


def length_counts(rows: DataFrame) -> DataFrame:
    """Counts of lengths by source and unit, and of those among them that end openly."""
    opened = F.col("reply_end").isin(R.OPEN, R.BROKEN, R.UNCLOSED, R.DASH) & F.col("prompt_end").isin(R.MARK, R.ELLIPSIS, R.NOTHING, R.BLOCK)
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("n"))))
    long = rows.where(F.col("reply_end") != R.NOTHING).select("service", opened.cast("int").alias("opened"), units.alias("u"))
    return long.groupBy("service", "u.unit", "u.n").agg(F.count("*").alias("k"), F.sum("opened").alias("k_open"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, opened: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(limit, values at it, expected there, log-odds of censoring) of each candidate limit of one source.

    Candidates are lengths at which far more values end openly than at the lengths around. The log-normal is
    fitted by expectation-maximisation of the right-censored likelihood: the share of open values at a limit counts
    as censored and is replaced by its expected logarithm beyond the limit.
    """
    if counts.sum() < 30:
        return []
    order = np.argsort(lengths)
    lengths, counts, opened = lengths[order].astype(np.int64), counts[order].astype(float), opened[order].astype(float)
    sums = np.concatenate(([0.0], np.cumsum(opened)))
    within = lambda lo, hi: sums[np.searchsorted(lengths, lengths + hi, side="right")] - sums[np.searchsorted(lengths, lengths + lo)]
    window, around = within(0, SLACK), within(-20, 20)
    around = (around - window) / (41 - SLACK - 1)
    peaks = np.flatnonzero((lengths >= 16) & (within(0, 0) >= 3) & (window >= np.maximum(8, 6 * (around + 0.2) * (SLACK + 1))))
    candidates, beside = [], set()
    for n in lengths[peaks[np.lexsort((lengths[peaks], -window[peaks]))]].tolist():
        if n not in beside:
            candidates.append(n)
            beside.update(range(n - 2 * SLACK, n + 2 * SLACK + 1))
    logs = np.log(np.maximum(lengths, 1))
    mean, sd = np.average(logs, weights=counts), 1.0
    at = np.zeros(len(lengths), dtype=bool)
    for n in candidates:
        at |= (lengths >= n) & (lengths <= n + SLACK)
    censored = np.where(at, opened, 0.0)
    for _ in range(25):
        z = (logs - mean) / sd
        tail = np.maximum(1e-9, 0.5 * np.array([math.erfc(x / math.sqrt(2)) for x in z]))
        hazard = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
        first = mean + sd * hazard
        second = sd * sd * (1 + z * hazard - hazard * hazard) + first * first
        total = counts.sum()
        s1 = ((counts - censored) * logs + censored * first).sum() / total
        s2 = ((counts - censored) * logs * logs + censored * second).sum() / total
        mean, sd = s1, math.sqrt(max(1e-4, s2 - s1 * s1))
    out = []
    for n in candidates:
        grid = np.arange(n, n + SLACK + 1)
        z = (np.log(grid) - mean) / sd
        density = np.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * sd * grid)
        expected = float(density.sum() * counts.sum())
        seen = float(counts[(lengths >= n) & (lengths <= n + SLACK)].sum())
        beyond = min(max(0.5, seen - expected), max(0.5, seen - 0.5))  # what the fitted lengths don't account for
        out.append((n, int(seen), expected, math.log(beyond / max(0.5, seen - beyond))))
    return out


def _fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
    found = fit_lengths(pdf["n"].to_numpy(), pdf["k"].to_numpy(), pdf["k_open"].to_numpy())
    return pd.DataFrame(
        [(pdf["service"].iloc[0], pdf["unit"].iloc[0], *f) for f in found], columns=["service", "unit", "limit", "n_at", "n_expected", "log_odds"]
    )


def fitted_limits(rows: DataFrame) -> DataFrame:
    """Candidate limits of every source. A group holds distinct lengths, not rows, so no source is too large."""
    return length_counts(rows).groupBy("service", "unit").applyInPandas(_fit_group, LIMITS)


def _asked_counts(held):
    """Counts of a bucket's words and pairs, of those only that are asked for, if these are given."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, sums = total_of(zip(pdf["keys"], pdf["sums"]))
        if held is not None:
            asked = held.value
            keep = asked[np.minimum(np.searchsorted(asked, keys), len(asked) - 1)] == keys if len(asked) else np.zeros(len(keys), dtype=bool)
            keys, sums = keys[keep], sums[keep]
        final = sums >> R.FINAL
        return pd.DataFrame({"word": keys.view(np.int64), "n_all": sums & ((1 << R.FINAL) - 1), "n_final": final})

    return run


def word_odds(features: DataFrame) -> DataFrame:
    """last_word, last_two, ``odds``: log-likelihood ratio of a cut behind them and of an end of a sentence, of all that end
    an open text; ``unmet`` if the word is nowhere else. Each last word and pair is joined once, not once a row."""
    spark = features.sparkSession
    ends = features.where("last_word is not null").select("last_word", "last_two").distinct()
    asked = ends.select(F.explode(F.array("last_word", "last_two")).alias("word")).where("word is not null").distinct()
    sent = features.where("bucket is not null").select("bucket", "keys", "sums")
    rows = features.where("bucket is null").select("n_words", "n_ends").agg(F.sum("n_words").alias("a"), F.sum("n_ends").alias("f")).first()
    base = (float(rows.f or 0) + 1.0) / (float(rows.a or 0) + 20.0)
    held = None
    if asked.count() <= HELD_WORDS:
        held = spark.sparkContext.broadcast(np.sort(asked.toArrow().column("word").to_numpy().view(np.uint64)))
    counts = sent.groupBy("bucket").applyInPandas(_asked_counts(held), "word bigint, n_all bigint, n_final bigint").join(asked, "word", "left_semi")
    one, two = (counts.select(F.col("word").alias(w), F.col("n_all").alias(f"a{k}"), F.col("n_final").alias(f"f{k}")) for k, w in ((1, "last_word"), (2, "last_two")))
    rated = ends.join(one, "last_word", "left").join(two, "last_two", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    p1 = (n("f1") + BACK * base) / (n("a1") + BACK)
    p2 = (n("f2") + BACK * p1) / (n("a2") + BACK)
    odds = F.log((1 - p2) / p2) + math.log(base / (1 - base))
    return rated.select(F.col("last_word").alias("w1"), F.col("last_two").alias("w2"), odds.alias("word_odds"), ((n("a1") <= 2) & (n("f1") == 0)).alias("unmet"))


def _supposed(t: int, o: int, level: int) -> float:
    """Log-odds that an ending is supposed to give at first: state of the text's end, of its original's, class of words."""
    word = SUPPOSED[level]
    if t == R.NOTHING:
        return -50.0
    if t == R.BROKEN:
        return 12.0
    if t in (R.MARK, R.BLOCK):
        return -12.0
    if t == R.UNCLOSED:
        return -3.0
    if t == R.ELLIPSIS:
        return -12.0 if o == R.ELLIPSIS else 8.0 if o in (R.MARK, R.OPEN, R.DASH) else word
    if t == R.DASH:
        return -8.0 if o == R.DASH else 8.0 if o == R.MARK else word
    return 10.0 if o in (R.MARK, R.ELLIPSIS, R.DASH, R.UNCLOSED) else word


def fit_endings(cells: list[tuple[int | None, int, int, int, int]]) -> tuple[dict[tuple[bool, int, int, int], float], float]:
    """Log-odds of each ending at limits and elsewhere, and the prior log-odds of values at no limit, by
    expectation-maximisation over three kinds of texts: whole ones, those cut at a limit, those cut in transfer.

    ``cells``: class of the prior (None: at no limit), states of both ends, class of words, rows. The classes are bounded
    in number, whatever the corpus.
    """
    free = math.log(PRIOR / (1 - PRIOR))
    endings = sorted({c[1:4] for c in cells})
    if not endings:
        return {}, free
    number, size = {e: k for k, e in enumerate(endings)}, len(endings)
    of, n = np.array([number[c[1:4]] for c in cells]), np.array([c[4] for c in cells], dtype=float)
    at = np.array([c[0] is not None for c in cells]).astype(int)
    prior = np.array([0.0 if c[0] is None else c[0] * WIDTH for c in cells])
    first = np.array([_supposed(*e) for e in endings])
    odds, given = np.stack((first, first)), None
    for _ in range(ROUNDS):
        r = 1 / (1 + np.exp(-np.clip(np.where(at == 1, prior, free) + odds[at, of], -60, 60)))
        cut = np.bincount(at * size + of, n * r, minlength=2 * size).reshape(2, size)
        whole = np.bincount(of, n * (1 - r), minlength=size)
        if given is None:  # what the supposed odds amount to, as occurrences of each ending in either class
            both = cut.sum(axis=0)
            given = TRUST * both / max(both.sum(), 1e-9), TRUST * whole / max(whole.sum(), 1e-9)
        a, b = cut + given[0] + 1e-6, whole + given[1] + 1e-6
        odds = np.log(a / a.sum(axis=1, keepdims=True)) - np.log(b / b.sum())
        odds[:, first <= -50.0] = -50.0
        elsewhere = n[at == 0].sum()
        share = (cut[0].sum() + PRIOR * 1.0) / (elsewhere + 1.0)
        free = math.log(share / (1 - share))
    return {(bool(k), *e): float(odds[k, number[e]]) for k in (0, 1) for e in endings}, free


def judged(features: DataFrame, books: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Rows of features with ``cut`` (the decision), ``cut_log_odds`` (its log-odds) and ``limit_log_odds`` (the censoring
    posterior at the candidate limits; null at none). ``limits``: as fitted_limits gives them, if they are at hand."""
    rows = with_books(features, books)
    limits = materialize(fitted_limits(rows)) if limits is None else limits
    best = limits.select(
        F.col("service").alias("of_service"), F.col("unit"), F.explode(F.sequence(F.col("limit"), F.col("limit") + SLACK)).alias("length"), "log_odds"
    )
    best = best.groupBy("of_service", "unit", "length").agg(F.max("log_odds").alias("odds"))
    for unit, column in (("chars", "n_chars"), ("bytes", "n_bytes")):
        one = best.where(F.col("unit") == unit).select("of_service", F.col("length").alias(f"at_{unit}"), F.col("odds").alias(f"odds_{unit}"))
        rows = rows.join(one, F.col("service").eqNullSafe(F.col("of_service")) & (F.col(column) == F.col(f"at_{unit}")), "left").drop("of_service", f"at_{unit}")
    rows = rows.withColumn("limit_log_odds", F.greatest("odds_chars", "odds_bytes"))
    # rows with an open end, a part of all, meet their words' odds; the others need none
    words = word_odds(features)
    asked = rows.where("last_word is not null").join(words, (F.col("last_word") == F.col("w1")) & F.col("last_two").eqNullSafe(F.col("w2")), "left").drop("w1", "w2")
    others = rows.where("last_word is null").withColumn("word_odds", F.lit(None).cast("double")).withColumn("unmet", F.lit(True))
    rows = asked.unionByName(others)
    level = F.when(F.coalesce("unmet", F.lit(True)) | F.col("word_odds").isNull(), len(LEVELS) + 1)
    for k, bound in enumerate(LEVELS):
        level = level.when(F.col("word_odds") < bound, k)
    rows = materialize(rows.withColumn("level", level.otherwise(len(LEVELS))).withColumn("prior_class", F.when(F.col("limit_log_odds").isNotNull(), F.round(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), "limit_log_odds")) / WIDTH).cast("int"))))
    cells = rows.groupBy("prior_class", "reply_end", "prompt_end", "level").count().collect()  # at most 42 * 8 * 8 * 7 rows
    odds, free = fit_endings(sorted(((r.prior_class, r.reply_end, r.prompt_end, r["level"], r["count"]) for r in cells), key=str))
    table = rows.sparkSession.createDataFrame([(*e, v) for e, v in odds.items()], "at_limit boolean, reply_end int, prompt_end int, level int, ending_odds double")
    decided = rows.withColumn("at_limit", F.col("limit_log_odds").isNotNull()).join(F.broadcast(table), ["at_limit", "reply_end", "prompt_end", "level"], "left")
    total = F.coalesce(F.col("limit_log_odds"), F.lit(free)) + F.coalesce("ending_odds", F.lit(-50.0))
    return decided.withColumn("cut_log_odds", total).withColumn("cut", total > 0)


def found(segments: DataFrame, books: DataFrame, samples: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """row_id of every row whose translated_text was cut off."""
    return judged(reply_features(segments, samples, glossary, False), books).where("cut").select("row_id")


def by_service(segments: DataFrame, books: DataFrame, samples: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """How often each source cuts: rows with a text, cut rows, their share, and the limits that were found."""
    features = reply_features(segments, samples, glossary, False)
    fitted = materialize(fitted_limits(with_books(features, books)))
    rows = judged(features, books, fitted)
    limits = fitted.groupBy(F.col("service").alias("s")).agg(F.array_sort(F.collect_set(F.concat_ws(" ", "limit", "unit"))).alias("limits"))
    shares = rows.where(F.col("reply_end") != R.NOTHING).groupBy("service").agg(
        F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("cut_share")
    )
    return shares.join(limits, F.col("service").eqNullSafe(F.col("s")), "left").drop("s")
