"""Operators of the training-data subpackage against brute force, round trips and held-out data."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versoflow.llm import alignment, charlm, cutting, defects, langid, mixing, packing, refusal, replies, sampling, splitting, subjects, sums, textkit, truncation

SEGMENTS = "row_id long, doc_id long, segment_id long, original_text string, translated_text string, is_new_chapter boolean, chapter_title string, content_type string, original_lang string, translated_lang string, extra string"


def segments(spark, pairs):
    rows = [(k, d, k, o, t, False, title, kind, ol, tl, "x") for k, (o, t, d, title, kind, ol, tl) in enumerate(pairs)]
    return spark.createDataFrame(rows, SEGMENTS)


@pytest.fixture(scope="module")
def samples(spark, data):
    return spark.read.parquet(f"{data}/lang_samples.parquet")


@pytest.fixture(scope="module")
def rows_of(samples):
    return [(r.lang, r.text) for r in samples.orderBy("lang", "sample_no").collect()]


EDGE = [
    (None, None, 1, None, "text", None, None), ("", "", 1, "", "text", "", ""), ("   ", "\n", 1, " ", None, "??", "en"), ("One sentence here is.", None, 1, "t", "text", "en", None),
    ("a" * 5000, "b" * 5000, None, "c" * 400, "image", "zz", "de"), ("\x00🙂", "﻿", 2, "x", "text", "en", "en"), ("One sentence here is.", None, 1, "t", "text", "en", None),
]


# --- sentences ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []), ("", []), ("a. b", ["a.", " b"]), ("He said “x.” Then", ["He said “x.”", " Then"]), ("1.5 is", ["1.5 is"]), ("好。坏！」吗", ["好。", "坏！」", "吗"]),
        ("a\r\n\r\nb", ["a", "b"]), ("...", ["..."]), ("x?!) y", ["x?!)", " y"]), ("。。a", ["。。", "a"]),
    ],
)
def test_sentences(text, want):
    assert textkit.sentences(text) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text("aBé .!?。！”’)\n\r#|`—12,漢字かカ🙂\u0301", max_size=25), max_size=6))
def test_cut_sentences_are_those_of_the_rule(texts):
    cut = cutting.Cut(texts, 1, True)
    for d, text in enumerate(texts):
        mine = slice(cut.of_doc[d], cut.of_doc[d + 1])
        parts = textkit.sentences(text)
        assert cut.number[mine].tolist() == list(range(1, len(parts) + 1))
        for part, a, b in zip(parts, cut.first[mine], cut.last[mine]):
            words = [cut.word(k) for k in range(a, b)]
            assert all(w for w in words) and bool(words) == any(c.isalnum() for c in part)


def test_cut_words():
    cut = cutting.Cut(["L'été, l’ete\u0301 1,234 or 1 234; 漢字かなカナ", None, ""], 1, True)
    words = [cut.word(k) for k in range(len(cut.key))]
    assert words == ["l'été", "l’eté", "1234", "or", "1234", "漢", "字", "かな", "カナ"]
    assert cut.key[2] == cut.key[4] and len(set(cut.key.tolist())) == 8
    assert [cutting.Cut(["漢字学 だ"], 2).word(k) for k in range(3)] == ["漢字", "学", "だ"]
    flagged = cutting.Cut(["# A b\n```\ncode here\n```\n| a | b |\nEnd."])
    assert flagged.heading.tolist() == [True, False, False, False, False, False] and flagged.code.tolist() == [False, True, True, True, False, False] and flagged.table.tolist()[4] and flagged.closed.tolist()[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(1, 9)), max_size=30), max_size=5), st.integers(1, 7))
def test_sums_by_bucket(parts, buckets):
    want, sent = {}, {}
    for part in parts:
        total = sums.Sums()
        for key, n in part:
            want[key] = want.get(key, 0) + n
            total.add(np.array([key], dtype=np.uint64), np.array([n]))
        for b in total.sent(buckets):
            sent.setdefault(b.column("bucket")[0].as_py(), []).append((b.column("keys")[0].as_py(), b.column("sums")[0].as_py()))
    got = {}
    for of_bucket in sent.values():
        keys, n = sums.total_of(iter(of_bucket))
        assert not set(keys.tolist()) & set(got)
        got |= dict(zip(keys.tolist(), n.tolist()))
    assert got == want


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000)
    a, b = ({r.id for r in sampling.by_hash(df.repartition(n), 50, "id").collect()} for n in (1, 7))
    assert a == b and len(a) == 50 and len(sampling.by_hash(df.where("id < 7"), 50, "id").collect()) == 7


# --- language models ---------------------------------------------------------------------------------------------


def test_kneser_ney_is_a_distribution():
    model = charlm.KneserNey({"x": ["ab", "abc", "b", "ab"]}, order=3)
    letters = [chr(c) for c in range(33, 400) if c not in (2, 3)]
    # one-letter tokens: p(c | start) * p(stop | start, c); summed over letters p(c | start) is at most one
    total = sum(np.exp(model.score([c])[0, 0]) for c in letters)
    assert 0 < total <= 1.0001
    assert model.score(["ab"])[0, 0] > model.score(["ba"])[0, 0]


@pytest.mark.parametrize("kind", [charlm.KneserNey, charlm.NaiveBayes])
def test_languages_held_out(rows_of, kind):
    model = kind(charlm.samples_by_language(rows_of[0::2]))
    detector = langid.Detector(model, {0: 1e9, 1: 1e9})
    odd = rows_of[1::2]
    s, lang, _, _ = detector.decide([t for _, t in odd])
    right = [detector.langs[k] == odd[d][0] for d, k in zip(s.doc, lang) if k >= 0]
    assert np.mean(right) > 0.97 and len(right) > 100


def test_language_cases(spark, samples):
    de, en = "Die Häuser stehen seit dem Winter im alten Hafen.", "The houses are standing in the old harbour since the winter."
    rows = [(en, de, 1, None, "text", "en-GB", "deu"), (en, de, 1, None, "text", "de", None), (f"{en} {de} {en}", "## Haus", 1, None, "text", "en", "de"), (None, "[Failed: x]", 1, None, "text", "en", "zh"), *EDGE]
    got = {(r.row_id, r.field): r for r in langid.detect_languages(segments(spark, rows), samples).collect()}
    assert (got[0, "original_text"].status, got[0, "translated_text"].status) == ("right", "right")
    assert (got[1, "original_text"].status, got[1, "translated_text"].status) == ("wrong", "missing")
    assert got[2, "original_text"].langs == ["de", "en"] and [(x.lang, x.first_no, x.last_no) for x in got[2, "original_text"].stretches] == [("en", 1, 1), ("de", 2, 2), ("en", 3, 3)]
    assert got[2, "translated_text"].status == got[3, "original_text"].status == got[3, "translated_text"].status == "none"
    assert len(got) == 2 * len(rows)
    assert langid.found(segments(spark, rows).where("false"), samples).count() == 0
    # a batch of one letter, a long sentence, one with an unbroken run, and a short one alone
    few = [("A", None, 1, None, "text", "en", "en")]
    assert langid.detect_languages(segments(spark, few), samples).count() == 2
    zh = "".join(rng_sentence for rng_sentence in ["我们在春天的早晨看见花园里的孩子和老人，他们说话，", "然后我们一起走到河边的老房子，"] * 8) + "没有人知道为什么。"
    more = [(zh, "The houses " + "x" * 400 + " are standing in the old harbour.", 1, None, "text", "zh", "en"), ("I know.", "漢" * 2000, 1, None, "text", "de", None)]
    got = {(r.row_id, r.field): r.langs for r in langid.detect_languages(segments(spark, more), samples).collect()}
    assert got[0, "original_text"] == ["zh"] and got[0, "translated_text"] == ["en"] and got[1, "original_text"] in (["en"], []) and got[1, "translated_text"] == []


# --- replies and truncation --------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", [None, "", " \n", "-", "…", '""', "<p></p>", "```\n\n```", "﻿ ", "[Failed: Timeout]", "[Translation Failed]", "Upstream error Failed]"])
def test_empty(text):
    assert replies.is_empty(text)


KNOWN = [("de", "Die Hunde lieben die Bäume im alten Hafen, das ist nicht wahr."), ("zh", "狗在春天的早晨喜爱花园里的树。"), ("fr", "Les chiens aiment les arbres.")] * 20
WORDS = refusal.weights(["The dogs love the trees, said Rud.", "“I am sorry, I cannot bring the songs today,” said Kor.", "In the old harbour, the children follow the clouds."] * 20, KNOWN, lambda texts: ["en"] * len(texts))


@pytest.mark.parametrize("text, want", [("As a language model I do not produce renderings of this kind.", True), ("Das mache ich nicht.", True), ("很抱歉，我做不到。", True), ("The dogs love the trees.", False), ("", False), ("I'm sorry, but I can't translate this passage.", True), ("无法翻译这段内容。", True), ("“I am sorry, I cannot bring the letters today,” said Rud.", False), ("Diese Anfrage muss ich ablehnen. Bitte senden Sie etwas anderes.", True)])
def test_refusals(text, want):
    assert (refusal.Refusals(WORDS).log_odds(cutting.Cut([text, None], han=1))[0] > 0) == want


def test_copies():
    text = "The bridges avoid the songs. The dogs love the trees during the night, as Rud wrote."
    assert replies.copied(text, text.upper()) and replies.copied(text, "Translation: " + text) and replies.copied(text, text.replace("love the ", ""))
    assert not replies.copied(text, "Die Brücken meiden die Lieder.") and not replies.copied("", "")


@pytest.mark.parametrize("text, want", [("a b.", replies.MARK), ("a b", replies.OPEN), ("a…", replies.ELLIPSIS), ("a:", replies.DASH), ("a�", replies.BROKEN), ('a b"', replies.BROKEN), ('"a."', replies.MARK), ("x\n```\ncode\n```", replies.BLOCK), (None, replies.NOTHING), ("a\\u4e", replies.BROKEN)])
def test_ends(text, want):
    assert replies.end_state(text) == want


def test_length_fit():
    rng = np.random.default_rng(1)
    n = np.round(np.exp(rng.normal(5.0, 0.8, 6000))).astype(int)
    cut = (n > 240) & (rng.random(6000) < 0.6)
    n = np.where(cut, 240, n)
    lengths = np.unique(n)
    counts = np.array([(n == v).sum() for v in lengths])
    opened = np.array([((n == v) & cut).sum() for v in lengths])
    found = truncation.fit_lengths(lengths, counts, opened)
    assert [f[0] for f in found] == [240] and found[0][3] > 1
    assert truncation.fit_lengths(lengths, counts, np.zeros_like(counts)) == []


def test_endings_are_weighed_by_the_censoring_posterior():
    # open ends beside open originals say little; at a limit most of them are cut, elsewhere few
    cells = [(None, R_MARK, R_MARK, 6, 9000), (None, R_OPEN, R_OPEN, 2, 400), (4, R_OPEN, R_OPEN, 2, 60), (4, R_MARK, R_MARK, 6, 10), (None, R_OPEN, R_MARK, 5, 200)]
    odds, free = truncation.fit_endings(cells)
    assert 2.0 + odds[True, R_OPEN, R_OPEN, 2] > 0 > free + odds[False, R_OPEN, R_OPEN, 2]
    assert free + odds[False, R_OPEN, R_MARK, 5] > 0 > 2.0 + odds[True, R_MARK, R_MARK, 6]
    assert truncation.fit_endings([]) [0] == {}


def test_limits_decide(spark, samples):
    rng = random.Random(8)
    nouns = ["houses", "dogs", "trees", "songs", "bridges", "letters"]
    # list entries: neither side ends with a mark; the service "s" cuts at 60 characters, "t" does not
    rows, doc = [], []
    for k in range(1200):
        text = " ".join(f"the {rng.choice(nouns)} and the {rng.choice(nouns)}" for _ in range(rng.randint(1, 4)))
        cut = k % 2 == 0 and len(text) > 60
        rows.append((text + ("." if k % 3 else ""), (text[:60] if cut else text + ("." if k % 3 else "")), 1 + k % 2, None, "text", "en", "en"))
        doc.append(cut)
    books = spark.createDataFrame([(1, "s", "de", "x"), (2, "t", "de", "x")], BOOKS)
    df = segments(spark, rows)
    features = truncation.reply_features(df, samples, None, False)
    judged = {r.row_id: r.cut for r in truncation.judged(features, books).collect()}
    none = truncation.fitted_limits(truncation.with_books(features, books)).where("false")
    without = {r.row_id: r.cut for r in truncation.judged(features, books, none).collect()}
    assert judged != without
    assert sum(judged[k] == doc[k] for k in judged) >= sum(without[k] == doc[k] for k in without)


R_MARK, R_OPEN = replies.MARK, replies.OPEN
BOOKS = "doc_id long, service string, target_lang string, name string"


def test_length_fit_beside_very_long_values_and_dense_bodies():
    lengths, counts = np.arange(50, 400), np.full(350, 20)
    lengths, counts, opened = np.append(lengths, [3000, 6_000_000]), np.append(counts, [60, 1]), np.append(np.full(350, 10), [55, 0])
    for part in (slice(None), slice(None, -1)):
        assert [f[0] for f in truncation.fit_lengths(lengths[part], counts[part], opened[part])] == [3000]
    lengths, counts, opened = np.arange(50, 400), np.full(350, 200), np.full(350, 100)
    lengths, counts, opened = np.append(lengths, 3000), np.append(counts, 60), np.append(opened, 55)
    assert 3000 in [f[0] for f in truncation.fit_lengths(lengths, counts, opened)]


def test_defects(spark, samples):
    o, t = "The houses are standing in the old harbour. The dogs love the trees.", "Die Häuser stehen im alten Hafen. Die Hunde lieben die Bäume."
    rows = [(o, x, 1, None, "text", "en", "de") for x in (t, "", "I cannot translate this text.", o, "Les maisons sont dans le vieux port. Les chiens aiment les arbres.", "Die Häuser stehen im alten Hafen. Die Hunde li")] + EDGE
    books = spark.createDataFrame([(1, "s", "de", "x")], BOOKS)
    got = {r.row_id: r.defect for r in defects.classify(segments(spark, rows), books, samples).collect()}
    assert [got[k] for k in range(6)] == [None, "empty", "refusal", "copy", "wrong_language", "truncated"]
    assert truncation.found(segments(spark, rows), books, samples).where("row_id = 5").count() == 1
    assert truncation.by_service(segments(spark, rows), books, samples).where("service = 's'").first().n_cut >= 1
    assert defects.found(segments(spark, rows).where("false"), books.where("false"), samples).count() == 0


# --- splitting ---------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text("ab .。\n#🇨🇭é👩‍🔬é，", max_size=400), st.integers(1, 60), st.integers(0, 40))
def test_pieces(text, limit, overlap):
    if len(text) <= limit:
        return
    parts = splitting.split(text, limit, overlap)
    for (s0, _, e0, _), (s, n, _, _) in zip(parts, parts[1:]):  # at least the overlap, or all of the piece before but one
        assert n == e0 and n - s >= min(overlap, limit - 1, e0 - s0 - 1)
    assert "".join(text[n:e] for _, n, e, _ in parts) == text
    assert all(0 < e - s <= limit and s <= n < e for s, n, e, _ in parts)
    if overlap == 0:
        assert all(s == n for s, n, _, _ in parts)


def test_pieces_keep_visible_characters():
    text = "👩‍🔬" * 300
    ends = {m.end() for m in regex.finditer(r"\X", text)}
    assert all(e in ends and (s == 0 or s in ends) for s, _, e, _ in splitting.split(text, 100, 10))


def test_pieces_prefer_topic_changes():
    a, b = "The cells grow in the lab. " * 6, "The judges read the laws. " * 6
    parts = splitting.split(a + b, 220, 0)
    assert parts[0][2] == len(a)


def test_very_long_texts_take_linear_time():
    import time

    began = time.time()
    assert len(splitting.split("same line here.\n" * 60_000, 2000, 150)) > 400
    assert len(splitting.split("x" * 1_000_000, 2000, 150)) > 500
    assert time.time() - began < 30


def test_splitting_rows(spark):
    limits = spark.createDataFrame([("original_text", 50, 5), ("chapter_title", 10, 2), (None, None, None), ("other", 1, 1)], "field string, max_chars int, overlap_chars int")
    rows = [("x " * 60, None, 1, "long title here", "text", None, None), *EDGE]
    got = splitting.found(segments(spark, rows), limits).collect()
    assert {(r.row_id, r.field) for r in got} == {(0, "original_text"), (0, "chapter_title"), (5, "original_text"), (5, "chapter_title")}
    assert splitting.found(segments(spark, rows).where("false"), limits).count() == 0


# --- packing and mixing ------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60))
def test_packing(sizes):
    a = np.array(sizes, dtype=np.int64)
    bins = packing.pack(a, 30)
    assert all(a[bins == b].sum() <= 30 for b in set(bins)) and (bins >= 0).all()
    used = len({int(b) for b, n in zip(bins, a) if n})
    assert used <= 1.5 * -(-int(a.sum()) // 30) + 1
    for b in set(bins):
        assert (3 * a[bins == b] > 30).sum() <= 2


DOCS = "doc_id long, text string, source string, book_id long, lang string, extra string"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, s, k % 5, "en", "x") for k, (t, s) in enumerate(rows)], DOCS)


def test_packing_documents(spark):
    df = docs(spark, [("word " * n, "s") for n in (0, 3, 30, 300)] + [(None, None), ("same", "s"), ("same", "s")])
    limits = spark.createDataFrame([("a", 64), ("b", 0), (None, None)], "profile string, capacity_tokens int")
    got = packing.assign(df, limits).collect()
    assert {r.doc_id for r in got} == set(range(7)) and {r.profile for r in got} == {"a"}
    fill = {}
    for r in got:
        fill[r.shard, r.container_no] = fill.get((r.shard, r.container_no), 0) + r.n_tokens
    assert max(fill.values()) <= 64 and sorted(r.part_no for r in got if r.doc_id == 3) == list(range(-(-sum(r.n_tokens for r in got if r.doc_id == 3) // 64)))
    assert packing.assign(df.where("false"), limits).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    df = docs(spark, [("word " * rng.randint(1, 60), s) for s in ["a"] * 300 + ["b "] * 200 + ["C"] * 20 + [None] * 5] + [(None, "a"), ("", "b")])
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.share_report(mixing.mix(df, targets, shards=8), targets).collect()}
    for s, share, cap in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)):
        assert report[s].share == pytest.approx(share, abs=0.01) and report[s].most_repeats <= cap
    assert report["none"].tokens == 0
    assert mixing.mix(df.where("false"), targets).count() == 0
    chosen = mixing.mix(df, targets, shards=8).collect()
    assert all(len(r.shards) == r.repeats and set(r.shards) <= set(range(8)) for r in chosen) and len({s for r in chosen for s in r.shards}) == 8


def test_slots():
    got = mixing.slot_counts({"a": 10, "b": 3}, 4)
    for s, n in (("a", 10), ("b", 3)):
        mine = sorted((f, f + c) for _, x, f, c in got if x == s)
        assert mine[0][0] == 0 and mine[-1][1] == n and all(p[1] == q[0] for p, q in zip(mine, mine[1:]))


# --- alignment ---------------------------------------------------------------------------------------------------

NOUNS = [("dogs", "Hunde"), ("trees", "Bäume"), ("houses", "Häuser"), ("songs", "Lieder"), ("letters", "Briefe"), ("bridges", "Brücken"), ("streets", "Straßen"), ("clouds", "Wolken"), ("children", "Kinder"), ("gardens", "Gärten")]
VERBS = [("love", "lieben"), ("follow", "verfolgen"), ("need", "brauchen"), ("avoid", "meiden"), ("visit", "besuchen")]


def test_alignment(spark, samples):
    rng = random.Random(9)
    rows, truth = [], set()
    for k in range(400):
        en, de = [], []
        for _ in range(rng.randint(2, 5)):
            (a, x), (b, y) = rng.sample(NOUNS, 2)
            v, w = rng.choice(VERBS)
            year = rng.randint(1000, 1999)
            en.append(f"The {a} {v} the {b} since {year}.")
            de.append(f"Die {x} {w} die {y} seit {year}.")
        order = list(range(len(en)))
        if rng.random() < 0.3:
            rng.shuffle(order)
        if rng.random() < 0.3:
            order.pop()
        truth |= {(k, i + 1, j + 1) for j, i in enumerate(order)}
        rows.append((" ".join(en), " ".join(de[i] for i in order), 1, None, "text", "en", "de"))
    got = {tuple(r) for r in alignment.align(segments(spark, rows + EDGE), samples).collect()}
    assert len(got & truth) > 0.97 * len(truth) and len(got - truth) < 0.03 * len(truth)
    long = [(" ".join(f"The {rng.choice(NOUNS)[0]} came in {k}." for k in range(3000)), " ".join(f"Im Jahr {k} kamen alle." for k in range(3000)), 1, None, "text", "en", "de")]
    linked = {tuple(r)[1:] for r in alignment.align(segments(spark, long + rows), samples).where("row_id = 0").collect()}
    assert len(linked & {(k, k) for k in range(1, 3001)}) > 2900
    same = [(rows[0][0], rows[0][0], 1, None, "text", "en", "en")]
    assert alignment.align(segments(spark, same), samples).count() == 0
    assert alignment.align(segments(spark, rows).where("false"), samples).count() == 0


def test_pairs_do_not_depend_on_partitions(spark, samples, monkeypatch):
    rng = random.Random(5)
    rows, compounds = [], [(a[0][:-1] + b[0], a[1] + b[1].lower()) for a in NOUNS for b in NOUNS[:4]]
    for k in range(300):
        n = rng.randint(1, 4)
        picks = [(rng.choice(compounds), rng.choice(VERBS), rng.choice(compounds)) for _ in range(n)]
        rows.append((" ".join(f"The {a[0]} {v[0]} the {b[0]}." for a, v, b in picks), " ".join(f"Die {a[1]} {v[1]} die {b[1]}." for a, v, b in picks), 1, None, "text", "en", "de"))
    # a rare pair, once in each of many partitions
    rows += [(f"Zorblax waited near the {k} gates.", f"Quintavo wartete nahe den {k} Toren.", 1, None, "text", "en", "de") for k in range(20)]
    got = [sorted(tuple(r) for r in alignment.align(segments(spark, rows).repartition(n), samples).collect()) for n in (1, 4, 16)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 500
    # a table that is too large to broadcast is joined to the blocks instead, and counts of words to those of pairs
    monkeypatch.setattr(alignment, "HELD_ROWS", 0)
    monkeypatch.setattr(alignment, "HELD_WORDS", 0)
    assert sorted(tuple(r) for r in alignment.align(segments(spark, rows).repartition(4), samples).collect()) == got[0]


def crc(word):
    return zlib.crc32(word.encode())


def side(lang, other, texts):
    """One row's sentences, each a list of words, as in a slice."""
    raw = np.array(sorted({crc(w) for words in texts for w in words}), dtype=np.uint64)
    inside = [sorted({int(np.searchsorted(raw, crc(w))) for w in words}) for words in texts]
    size = np.array([len(x) for x in inside], dtype=np.int64)
    word = np.array([k for x in inside for k in x], dtype=np.int64)
    numbers = alignment._salted(raw, np.full(len(raw), other)).astype(np.uint32)
    return alignment.Side(np.array([len(texts)]), np.full(len(texts), lang, dtype=np.uint8), size, word, numbers, raw.astype(np.uint32))


def table_of(pairs=(), of=0.9):
    s, t = ([int(alignment._salted(np.array([crc(p[k])], dtype=np.uint64), np.array([1 - k]))[0]) for p in pairs] for k in (0, 1))
    same = pa.array([of] * len(pairs), pa.float64())
    return alignment.Table(pa.table({"source": pa.array(s, pa.int64()), "target": pa.array(t, pa.int64()), "p": same, "of_s": same, "of_t": same}))


def linked(o, t, pairs=(), of=0.9):
    """Links of one row by a table of the given word pairs."""
    i, j, _ = alignment.link(side(0, 1, o), side(1, 0, t), table_of(pairs, of))
    return sorted(zip(i.tolist(), j.tolist()))


def test_expectation_shares_every_target_word(spark):
    o, t = side(0, 1, [["a", "b", "c"], ["d"]]), side(1, 0, [["x", "y"], ["z"]])
    i = j = np.arange(2)
    finder = alignment.Finder(o, t, table_of([("a", "x")]))
    hits = finder.of_pairs(i, j)
    total = sums.Sums()
    alignment._share(total, o, t, i, j, hits)
    total.merge()
    pairs = {(int(k >> 32), int(k & 0xFFFFFFFF)): n / alignment.GRAIN for k, n in zip(total.keys.tolist(), total.sums.tolist())}
    number = lambda s, w: int(s.vocabulary[np.searchsorted(s.raw, crc(w))])
    # x falls to a; y, for which the table has nothing, to the words that explain nothing else
    assert pairs[number(o, "a"), number(t, "x")] == 1 and (number(o, "a"), number(t, "y")) not in pairs
    assert pairs[number(o, "b"), number(t, "y")] == pairs[number(o, "c"), number(t, "y")] == 0.5 and pairs[number(o, "d"), number(t, "z")] == 1
    assert pairs[number(o, "a"), alignment.MASS] == 1


def test_links_far_from_the_diagonal():
    rng = random.Random(3)
    o = [[f"w{k}", f"v{k}", "the"] for k in range(120)]
    order = list(range(120))
    rng.shuffle(order)
    assert linked(o, [o[k] for k in order]) == sorted((k, at) for at, k in enumerate(order))


def test_crowded_words_are_matched_near_the_diagonal():
    refrain = [["aldwin", "borough"]] * 200
    assert linked(refrain, refrain) == [(k, k) for k in range(200)]


def test_words_are_looked_up_once_a_row_and_weighed_as_by_hand(monkeypatch):
    rng = random.Random(8)
    pairs = [(f"o{a}", f"t{b}") for a in range(30) for b in rng.sample(range(30), 3)]
    o, t = ([["the", *(f"{name}{k}" for k in rng.sample(range(30), 4))] for _ in range(n)] for name, n in (("o", 90), ("t", 80)))
    original, translated = side(0, 1, o), side(1, 0, t)
    explains = {*pairs, ("the", "the")}
    of = {x: alignment.IDENTITY if x == ("the", "the") else float(np.float32(0.4)) for x in explains}
    every = [np.ones(n, dtype=bool) for n in (90, 80)]

    def by_hand(i, j):
        sums_ = []
        for mine, value in ((o[i], lambda w: [of[w, x] for x in t[j] if (w, x) in explains]), (t[j], lambda w: [of[x, w] for x in o[i] if (x, w) in explains])):
            sums_.append(sum(min(1.0, sum(value(w))) for w in mine) / len(mine))
        return sums_

    seen = []
    for slots in (alignment.MANY_SLOTS, 0):  # held in place, and sorted
        monkeypatch.setattr(alignment, "MANY_SLOTS", slots)
        finder = alignment.Finder(original, translated, table_of(pairs, 0.4))
        assert len(finder.matches[0]) == len(explains)  # not once for each of the sentences that have the word
        near = finder.weighed(finder.near_diagonal(*every, -1, alignment.BANDS[0]))
        far = finder.weighed(finder.anywhere(*every))
        for found, is_near in ((near, True), (far, False)):
            for i, j, f_o, f_t in zip(*(x.tolist() for x in found)):
                assert (abs(j - finder.near[i]) <= alignment.BANDS[0]) == is_near
                assert by_hand(i, j) == pytest.approx([f_o, f_t])
        # the bound leaves out no pair that can be linked or joined
        sure = {(i, j, a, b) for i, j, a, b in zip(*(x.tolist() for x in far)) if 2 * a * b >= alignment.GAP * (a + b) or a >= alignment.JOIN or b >= alignment.DIVIDED}
        bounded = set(zip(*(x.tolist() for x in finder.weighed(finder.anywhere(*every), bounded=True))))
        assert sure and sure <= bounded <= set(zip(*(x.tolist() for x in far)))
        seen.append([x.tolist() for found in (near, far) for x in found])
    assert seen[0] == seen[1] and len(seen[0][0]) > 700 and len(seen[0][4]) > 4000


def test_unlinked_sentences_between_linked_neighbours():
    o = [["anna", "1"], ["unheard"], ["berta", "2"]]
    t = [["anna", "1"], ["nievernommen"], ["berta", "2"]]
    assert linked(o, t) == [(0, 0), (1, 1), (2, 2)]
    # known words without anything in common speak against it
    assert linked(o, t, [("unheard", "ungehört")]) == [(0, 0), (2, 2)]


def test_divisions_and_merges_into_three():
    whole = ["a1", "a2", "b1", "b2", "b3", "b4", "c1", "c2"]
    # the middle part explains most and wins; the first part is in front of it
    assert linked([whole, ["z9"]], [["a1", "a2"], ["b1", "b2", "b3", "b4"], ["c1", "c2"], ["z9"]]) == [(0, 0), (0, 1), (0, 2), (1, 3)]
    # the first part wins, the third is two away from it
    assert linked([whole, ["z9"]], [["b1", "b2", "b3", "b4"], ["a1", "a2"], ["c1", "c2"], ["z9"]]) == [(0, 0), (0, 1), (0, 2), (1, 3)]
    assert linked([["b1", "b2", "b3", "b4"], ["a1", "a2"], ["c1", "c2"], ["z9"]], [whole, ["z9"]]) == [(0, 0), (1, 0), (2, 0), (3, 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 30)), max_size=30, unique_by=lambda x: x[:2]))
def test_competitive_linking(edges):
    i, j, w = (np.array([e[k] for e in edges], dtype=np.int64) for k in range(3))
    got = set(zip(*(x.tolist() for x in alignment._compete(i, j, w.astype(float), 7, 7))))
    want, used_i, used_j = set(), set(), set()
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if a not in used_i and b not in used_j:
            want.add((a, b)), used_i.add(a), used_j.add(b)
    assert got == want


# --- subjects ----------------------------------------------------------------------------------------------------


def test_units():
    assert subjects.units(None) == [] and subjects.units("- **a**: b\n- c") == ["- **a**: b", "- c"]
    assert [u.strip() for u in subjects.units('[{"id": 0, "translation": "A b."}, {"id": 1, "translation": "C d."}]') if any(c.isalpha() for c in u)][-1].startswith('"C d.')
    assert subjects.units("The first line of this text that is quite long\nand goes on in the second one which is longer\nuntil it ends here. New one") == [
        "The first line of this text that is quite long and goes on in the second one which is longer until it ends here.", " New one",
    ]


def test_subjects_without_books(spark):
    rows = [("The judges read the verdicts. " * 5 if k % 2 else "The dogs love the trees. " * 5, "s") for k in range(200)]
    df = docs(spark, rows).withColumn("book_id", F.lit(None).cast("long"))
    labels = spark.createDataFrame([(k, "law") for k in range(1, 60, 2)] + [(k, "none") for k in range(0, 60, 2)], "doc_id long, subject string")
    names = spark.createDataFrame([("law",), ("none",)], "subject string")
    got = {r.doc_id for r in subjects.found(df, labels, names).where("subject = 'law'").collect()}
    assert got == set(range(1, 200, 2))


def test_fitting_topics_changes_the_result(spark, data):
    tables = [spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "subject_labels", "subjects")]
    a, b = ({(r.doc_id, *r.shares) for r in subjects.shares(*tables, rounds=n)[0].collect()} for n in (0, 8))
    assert a != b


def test_subjects(spark):
    rng = random.Random(2)
    words = {"law": ["judges", "courts", "verdicts", "appeals", "lawyers", "fines"], "food": ["soups", "noodles", "eggs", "ovens", "spices", "onions"]}
    common = ["trees", "dogs", "streets", "houses", "letters", "clouds"]
    rows, truth, labels = [], {}, []
    for k in range(600):
        of = rng.choice([[], ["law"], ["food"], ["law", "food"]])
        text = " ".join(f"The {rng.choice(words[rng.choice(of)] if of and rng.random() < 0.8 else common)} see the {rng.choice(common)} today." for _ in range(14))
        rows.append((text, "s"))
        truth[k] = set(of)
        if k % 4 == 0:
            labels += [(k, s) for s in of]
    df = docs(spark, rows + [(None, "s"), ("", "s"), ("...", None)])
    labelled = spark.createDataFrame([*labels, (None, "law"), (99999, "food"), (4, None), (0, "unknown")], "doc_id long, subject string")
    names = spark.createDataFrame([("law", "d"), ("food", "d"), (None, "d")], "subject string, description string")
    got = {k: set() for k in range(603)}
    for r in subjects.found(df, labelled, names).collect():
        got[r.doc_id].add(r.subject)
    assert np.mean([got[k] == truth[k] for k in range(600)]) > 0.9 and not got[600] | got[601] | got[602]
    assert subjects.found(df.where("false"), labelled, names).count() == 0


def test_glossary_seed_has_all_words_of_long_entries(spark, monkeypatch):
    from versoflow.llm import alignment

    term, translation = " ".join(f"quay{'abcdefghijkl'[k]}" for k in range(12)), " ".join(f"kai{'abcdefghij'[k]}" for k in range(10))
    rows = [(term, translation, "en", "de"), ("storks", "Störche", "en", "de"), (term, translation, "en", "de"), ("...", "x", "en", "de"), (None, "x", "en", "de"), ("a", "b", "xx", "de")]
    glossary = spark.createDataFrame(rows, "term string, translation string, source_lang string, target_lang string")
    got = [tuple(r) for r in alignment.glossary_seed(glossary, ["de", "en"]).collect()]
    assert len(got) == len(set(got)) == 12 * 10 + 1
    assert len({s for s, _ in got}) == 13 and len({t for _, t in got}) == 11
    monkeypatch.setattr(alignment, "WORD_PAIRS", 7)  # made in parts
    assert {tuple(r) for r in alignment.glossary_seed(glossary, ["de", "en"]).collect()} == set(got)


# --- queries -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "p5_found", "p8_found", "p8_subject_shares", "p7_shares", "p6_fill"])
def test_queries_run(spark, data, name):
    from versoflow.llm import queries

    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert len({tuple(r) for r in rows}) == len(rows)


def test_found_against_sql(spark, data):
    import duckdb

    from versoflow.llm import queries

    con = duckdb.connect()
    for t in ("segments", "size_limits"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    assert {tuple(r) for r in queries.p3_found(spark, data).collect()} == set(con.sql(queries.SQL["p3_found"]).fetchall())


def test_columns(spark, data):
    from versoflow.llm import queries

    want = {"p1_found": ["row_id", "original_no", "translated_no"], "p2_found": ["row_id", "defect"], "p4_found": ["row_id"], "p5_found": ["row_id", "field", "lang"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, data).columns == columns
    assert F is not None


def test_tokens_against_the_library(spark):
    import tiktoken

    from versoflow.llm import tokens

    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}", "rb"))}
    encode = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = ["The dogs love 12 trees.", "漢字かな ", None, "", "a\n\n b"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    assert [r.n_tokens for r in tokens.token_counts(df, ["id"]).orderBy("id").collect()] == [len(encode(t)) if t else 0 for t in texts]
