import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versoflow.functions import repair as J
from versoflow.operators import cache, context, glossary, matching, models, ordered, segment, status, titles, toc

SEGMENTS = "row_id long, doc_id long, segment_id long, original_text string, translated_text string, is_new_chapter boolean, chapter_title string, page_index int, toc_level int, content_type string, image_path string, loaded_at timestamp"


def segments(spark, rows):
    full = [(k, 1, k, "", "", False, "", 0, 1, "text", None, None) for k in range(len(rows))]
    names = [f.split(" ")[0] for f in SEGMENTS.split(", ")]
    out = [tuple(r.get(n, d) for n, d in zip(names, base)) for r, base in zip(rows, full)]
    return spark.createDataFrame(out, SEGMENTS)


def test_toc_paths_and_map(spark):
    items = [(1, 0, 1, " A ", "0"), (1, 1, 3, "B", "1#x"), (1, 2, 2, "C", "1"), (1, 3, 0, None, "2"), (1, 4, 1, "E", None)]
    df = spark.createDataFrame(items, "doc_id long, ord int, level int, title string, key string")
    assert [r.path for r in toc.heading_paths(df).orderBy("ord").collect()] == ["A", "A > B", "A > C", "", "E"]
    assert {(r.key, r.title) for r in toc.chapter_map(df).collect()} == {("0", "A"), ("1", "A > B"), ("2", "")}
    assert {(r.key, r.level) for r in toc.chapter_map(df, False).collect()} == {("0", 1), ("1", 3), ("2", 1)}
    assert toc.chapter_map(df.where("false")).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30))
def test_path_depth(spark, levels):
    df = spark.createDataFrame([(1, k, n, f"t{k}", str(k)) for k, n in enumerate(levels)], "doc_id long, ord int, level int, title string, key string")
    stack, want = [], []
    for k, n in enumerate(levels):
        if len(stack) >= n:
            stack = stack[: n - 1]
        stack.append(f"t{k}")
        want.append(" > ".join(stack))
    assert [r.path for r in toc.heading_paths(df).orderBy("ord").collect()] == want


def test_csv_toc(spark):
    rows = [(1, 0, "1", " One ", None), (1, 1, "", "x", "1"), (1, 2, "0", "neg", "1"), (1, 3, "7", None, "2"), (2, 0, "x", "bad", "1"), (2, 1, "3", "ok", "1")]
    df = spark.createDataFrame(rows, "doc_id long, ord int, page string, title string, level string")
    assert [tuple(r) for r in toc.csv_items(df).orderBy("ord").collect()] == [(1, 0, 1, "One", "0"), (1, 3, 2, "Page 7", "6")]


def test_csv_file(spark, tmp_path):
    from versoflow.sources.toc_csv import read_toc_csv

    (tmp_path / "t.csv").write_text("﻿页码, 标题 ,Level\n1, Start,1\n5,More,2\n", encoding="utf-8")
    assert [(r.title, r.level, r.key) for r in read_toc_csv(spark, str(tmp_path / "t.csv"), 9).orderBy("ord").collect()] == [("Start", 1, "0"), ("More", 2, "4")]


def test_first_source(spark):
    schema = "doc_id long, ord int, level int, title string, key string"
    a = spark.createDataFrame([(1, 0, 1, "a", "0")], schema)
    b = spark.createDataFrame([(1, 0, 1, "b", "0"), (2, 0, 1, "c", "0")], schema)
    assert {(r.doc_id, r.title) for r in toc.first_source(a, b).collect()} == {(1, "a"), (2, "c")}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 40), st.one_of(st.none(), st.integers(0, 9))), max_size=40, unique_by=lambda r: r[:2]))
def test_blocked_windows_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, pos long, v int")
    by = {}
    for doc, pos, v in sorted(rows, key=lambda r: r[:2]):
        by.setdefault(doc, []).append((pos, v))
    fill, sums, before = {}, {}, {}
    for doc, seq in by.items():
        last, total = None, 0
        for k, (pos, v) in enumerate(seq):
            last = v if v is not None else last
            total += v or 0
            fill[doc, pos], sums[doc, pos], before[doc, pos] = last, total, [x for _, x in seq[max(0, k - 3) : k]]
    assert {(r.doc_id, r.pos): r.v for r in ordered.forward_fill(df, "doc_id", "pos", ["v"], block=4).collect()} == fill
    assert {(r.doc_id, r.pos): r.s for r in ordered.running_sum(df, "doc_id", "pos", F.col("v"), "s", block=4).collect()} == sums
    assert {(r.doc_id, r.pos): r.p for r in ordered.preceding(df, "doc_id", "pos", F.col("v"), 3, "p", block=4).collect()} == before


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.booleans(), st.integers(0, 2)), min_size=1, max_size=40))
def test_chunks_keep_text_and_limits(spark, units):
    rows = [(1, k, str(k), k, ("x" * n) if n else "y", "image" if image else "text") for k, (n, image, _) in enumerate(units)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, unit_key string, page_index int, content string, content_type string")
    chapters = spark.createDataFrame([(1, str(k), f"c{c}", 1) for k, (_, _, c) in enumerate(units) if c], "doc_id long, key string, title string, level int")
    out = segment.segments_from_units(df, chapters, 50).orderBy("segment_id").collect()
    assert [r.segment_id for r in out] == list(range(len(out)))
    texts = [r[4] for r in rows if r[5] == "text"]
    assert "\n\n".join(r.original_text for r in out if r.content_type == "text") == "\n\n".join(texts)
    assert sum(r.n_units for r in out) == len(rows) and all(r.n_units == 1 for r in out if r.content_type == "image")


def test_chunk_texts_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n"), (4, "a\nb"), (5, "x" * 2500 + "\ny")], "doc_id long, text string")
    got = {(r.doc_id, r.segment_id): r.original_text for r in segment.chunk_texts(df).collect()}
    assert got == {(4, 0): "a\n\nb", (5, 0): "x" * 2500, (5, 1): "y"}
    assert segment.chunk_texts(df.where("false")).count() == 0


def test_reject(spark):
    df = segments(spark, [{"content_type": "image"}, {"image_path": "p"}, {}, {"content_type": "image", "image_path": "p"}])
    good, bad = segment.reject_invalid(df)
    assert good.count() == 2 and {r.reason for r in bad.collect()} == {"image without path", "text with path"}


def test_context(spark):
    df = segments(spark, [{"original_text": " a" * 600, "translated_text": "t0"}, {"original_text": None, "translated_text": "[Translation Failed]"}, {"original_text": "c", "translated_text": " t2 "}, {"translated_text": "t3"}])
    prev = [r.context for r in context.previous_context(df, 100, 20).orderBy("segment_id").collect()]
    assert prev == ["", ("a " * 10).strip(), "", "c"]
    assert [r.window for r in context.translated_window(df).orderBy("segment_id").collect()] == ["", "t0", "t0", "t0 t2"]
    assert context.previous_context(df.where("false")).count() == 0


CHECKPOINT = "doc_id long, completed_segments array<long>, failed_segments array<struct<segment_id:long,error:string,timestamp:string>>, total_segments long, start_time string, last_update string"


def test_pending_and_progress(spark):
    df = segments(spark, [{"translated_text": "ok"}, {"translated_text": "[Failed: x]"}, {"translated_text": "ok"}, {"translated_text": None}])
    points = spark.createDataFrame([(1, [0, 1, 0], [(9, "e", "t")], 4, "s", "u"), (2, None, None, None, None, None)], CHECKPOINT)
    assert {(r.segment_id, r.why) for r in status.pending(df, points).collect()} == {(1, "failed content"), (2, "not completed"), (3, "not completed")}
    assert {(r.doc_id, r.n_completed, r.n_pending, r.percent) for r in status.progress(points).collect()} == {(1, 2, 2, 50.0), (2, 0, 0, 0.0)}
    assert status.pending(df, points.where("false")).count() == 4


def test_marking(spark):
    points = spark.createDataFrame([(1, [0, 1], [(5, "e", "t0")], 4, "s", "t0")], CHECKPOINT)
    events = spark.createDataFrame([(1, 5, "completed", None, "t1"), (1, 1, "failed", "x", "t1"), (1, 1, "removed", None, "t0"), (2, 3, "completed", None, "t2")], "doc_id long, segment_id long, event string, error string, timestamp string")
    got = {r.doc_id: r for r in status.mark(points, events).collect()}
    assert got[1].completed_segments == [0, 5] and [(f.segment_id, f.error) for f in got[1].failed_segments] == [(1, "x")] and got[1].last_update == "t1"
    assert got[2].completed_segments == [3] and got[2].failed_segments == []


def brute_saturation(counts, low_terms, most, share):
    total, low, used, out = 0, 0, True, []
    for k in range(len(counts)):
        total += counts[k]
        stops = total >= most
        if total >= low_terms and k >= 2:
            low = low + 1 if sum(counts[k - 2 : k + 1]) / 3 < sum(counts[: k + 1]) / (k + 1) * share else 0
            stops = stops or low >= 2
        out.append((stops, used))
        if stops:
            used = False
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=14))
def test_saturation_against_brute_force(spark, counts):
    n, rows = 0, []
    for b, c in enumerate(counts):
        rows += [(b, k, f"t{n + k}", "x") for k in range(c)] + [(b, 99, "t0" if n else None, "y")]
        n += c
    df = spark.createDataFrame(rows, "batch_id int, ord int, term string, translation string")
    got = glossary.saturation(df, 8, 30, 0.8).orderBy("batch_id").collect()
    want = brute_saturation(counts, 8, 30, 0.8)
    first = next((k for k, (s, _) in enumerate(want) if s), len(want) - 1)
    assert [(r.stops, r.used) for r in got][: first + 1] == want[: first + 1]
    assert all(not r.used for r in got[first + 1 :]) and [r.new_terms for r in got] == counts


def test_glossary_merge(spark):
    df = spark.createDataFrame([(0, 0, " a ", "1"), (1, 0, "a", "2"), (0, 1, None, "x"), (0, 2, "b", " ")], "batch_id int, ord int, term string, translation string")
    got = glossary.merged(df)
    assert [tuple(r) for r in got.collect()] == [("a", "2", 0, 0, 2)]
    assert glossary.as_list(got).first().glossary_text == "- **a**: 2"


def test_titles(spark):
    df = segments(spark, [{"is_new_chapter": True, "chapter_title": "One"}, {"is_new_chapter": True, "chapter_title": "一"}, {"is_new_chapter": None, "chapter_title": "Two"}, {"is_new_chapter": True, "chapter_title": None}])
    assert [r.title for r in titles.candidates(df).collect()] == ["One"]
    done = spark.createDataFrame([("One", "Eins"), ("Two", " ")], "title string, translated_title string")
    assert [r.chapter_title for r in titles.backfill(df, done).orderBy("row_id").collect()] == ["Eins", "一", "Two", None]


def test_translation_map_and_match(spark):
    o = "First paragraph of it.\n\nSecond  paragraph of it."
    df = segments(spark, [{"original_text": o, "translated_text": "A\n\nB\n\nC"}, {"original_text": "Second paragraph of it.", "translated_text": "late"}, {"original_text": "one only paragraph", "translated_text": "x\n\ny"}])
    got = {r.key: r.translation for r in matching.translation_map(df).collect()}
    assert got == {"First paragraph of it. Second paragraph of it.": "A\n\nB\n\nC", "First paragraph of it.": "A", "Second paragraph of it.": "B\n\nC", "one only paragraph": "x\n\ny"}
    blocks = spark.createDataFrame([(1, "Second paragraph   of it."), (2, "nothing like this at all here"), (3, None)], "id long, text string")
    assert {(r.id, r.translation, r.how) for r in matching.match(blocks, matching.translation_map(df), "id").collect()} == {(1, "B\n\nC", "exact"), (2, None, None), (3, None, None)}


def test_fuzzy_loses_nothing(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(25)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 24))) for _ in range(60)] + ["犬は木を守る。" * 2, "橋は雲を愛する。"]
    blocks = []
    for k in range(60):
        w = rng.choice(texts).split()
        if rng.random() < 0.5 and len(w) > 2:
            w.pop(rng.randrange(len(w)))
        t = " ".join(w)
        blocks.append((k, t[: rng.randint(max(1, len(t) - 4), len(t))] if rng.random() < 0.5 else t))
    mapping = [(t, f"T{k}", (1, k, k, 0)) for k, t in enumerate(dict.fromkeys(texts))]
    m = spark.createDataFrame(mapping, "key string, translation string, at struct<doc_id:long,segment_id:long,row_id:long,rank:int>")
    got = {r.id: (r.translation, round(r.score, 6)) for r in matching.fuzzy_match(spark.createDataFrame(blocks, "id long, text string"), m, "id").collect()}
    from tests.test_text import brute_similarity

    want = {}
    for i, text in blocks:
        t = " ".join(text.split())
        best = (0.85, None)
        for key, translation, _ in mapping:
            if len(t) >= 10 and len(key) >= 10 and (s := brute_similarity(t, key)) > best[0]:
                best = (s, translation)
        if best[1]:
            want[i] = (best[1], round(best[0], 6))
    assert got == want and len(want) > 20


def test_fuzzy_candidates_against_brute_force(spark):
    from tests.test_text import brute_similarity

    rng = random.Random(11)
    words = ["international", "houses", "犬は木", "the", "quick", "brown", "fox", "中", "over", "jumping", "守る橋雲"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ["international", "internationa", "the quick brown fox jumps over it", "the quick brown fox jumps over it 中"]
    for t in base:
        texts.append(t)
        cut = rng.randint(0, 4)
        texts += [t[cut:], t[: len(t) - cut], f"{t} 中", f"x{t}", t.replace("o", "p", 1), t.upper()]
    texts = sorted({" ".join(t.split()) for t in texts if len(" ".join(t.split())) >= 10})
    left, right = texts[::2], texts[1::2]
    found = matching.candidates(*(spark.createDataFrame([(t,) for t in x], "s string") for x in (left, right)))
    got = {(r.a, r.key) for r in found.collect()}
    want = {(a, b) for a in left for b in right if brute_similarity(a, b) > matching.LIKE}
    assert want <= got and len(want) > 30 and len(got) < len(left) * len(right) / 3


def test_fuzzy_shuffles_no_text_of_the_table(spark):
    def written():
        rows = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(rows.apply(k).totalShuffleWrite() for k in range(rows.size()))

    rng = random.Random(5)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(400)) for _ in range(400)]
    mapping = spark.createDataFrame([(t, f"T{k}", (1, k, k, 0)) for k, t in enumerate(texts)], "key string, translation string, at struct<doc_id:long,segment_id:long,row_id:long,rank:int>")
    blocks = spark.createDataFrame([(k, texts[k].rsplit(" ", 20)[0]) for k in range(3)], "id long, text string")
    before = written()
    assert {(r.id, r.translation) for r in matching.fuzzy_match(blocks, mapping, "id").collect()} == {(k, f"T{k}") for k in range(3)}
    assert written() - before < sum(map(len, texts)) / 4


def test_fuzzy_entries_of_live_rows(spark):
    o = "The storks of the old harbour counted their ships before noon, and many of them left again."
    rows = [(0, 1, 4, o, "old"), (1, 1, 4, o, "new"), (2, None, 5, o + " x", "none")]
    df = segments(spark, [{"row_id": r, "doc_id": d, "segment_id": s, "original_text": a, "translated_text": b} for r, d, s, a, b in rows])
    blocks = spark.createDataFrame([(1, o), (2, o + " x"), (3, None)], "id long, text string")
    live = status.latest_ids(df)
    got = matching.fuzzy_match(blocks, matching.entries(df), "id", live=live).collect()
    assert {(r.id, r.translation, r.score) for r in got} == {(1, "new", 1.0), (2, "none", 1.0)}
    want = matching.fuzzy_match(blocks, matching.translation_map(status.latest_segments(df)), "id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_running_context_has_no_reach(spark):
    # rows of one letter, empty and null ones: the last 500 characters go back over hundreds of rows, across stretches
    rng = random.Random(2)
    rows = [(k, d, k // 3, rng.choice([None, "", "a", "bc", "long " * 150])if rng.random() < 0.1 else "x") for d in (1, 2, None) for k in range(700)]
    df = spark.createDataFrame([(100000 * (d or 3) + k, d, n, t) for k, d, n, t in rows], "row_id long, doc_id long, segment_id long, translated_text string")
    got = {r.row_id: r.running for r in context.vision_context(df).collect()}
    for d in (1, 2, None):
        before = []
        for r in sorted((r for r in df.collect() if r.doc_id == d), key=lambda r: (r.segment_id, r.row_id)):
            assert got[r.row_id] == "\n".join(before)[-500:]
            before.append(r.translated_text or "")


REPLIES = [
    ('[{"id": 1, "translation": "a\\"b"}, {"id": 2, "translation": "c"}]', ["a\"b", "c"], "strict"),
    ('```json\n[{"id": "1", "translation": "a"}, {"id": 2}]\n```', ["a", ""], "strict"),
    ('[{"id": 1, "translation": "a."}, {"id": 2, "translation": "cut o', ["a.", "[Failed: Missing in response]"], "fallback"),
    ("[{'id': 1, 'translation': 'a'}, {'id': 2, 'translation': 'b'}]", ["a", "b"], "fallback"),
    ('[{"id": 1, "translation": "x"}, {"id": 1, "translation": "y"}]', ["y", "[Failed: Missing translation]"], "strict"),
    ("no idea", ["[Failed: JSON Parse Error]"] * 2, "failed"),
    (None, ["[Failed: JSON Parse Error]"] * 2, "failed"),
    ('[{"id": 1, "translation": "a"}, {"id": 2, "translation": "open"', ["a[...翻译被截断]", "[Failed: Missing in response]"], "fallback"),
    ('[{"id": 1, "translation": "open"', ["open[...翻译被截断]", "[Failed: Missing in response]"], "fallback"),
    ('{"a": "b"}', ["[Failed: Missing translation]"] * 2, "strict"),
]


def test_replies(spark):
    df = spark.createDataFrame([(k, 1, [1, 2], raw) for k, (raw, _, _) in enumerate(REPLIES)], "doc_id long, batch_id long, expected_ids array<long>, raw_text string")
    got = {}
    for r in J.parse_responses(df).orderBy("doc_id", "segment_id").collect():
        got.setdefault(r.doc_id, []).append((r.translation, r.route))
    for k, (_, texts, route) in enumerate(REPLIES):
        assert got[k] == [(t, route) for t in texts], REPLIES[k][0]


def test_long_reply_does_not_overflow(spark):
    raw = '[{"id": 1, "translation": "' + "x" * 300_000 + '"}, {"id": 2, "trans'
    df = spark.createDataFrame([(1, 1, [1], raw)], "doc_id long, batch_id long, expected_ids array<long>, raw_text string")
    assert len(J.parse_responses(df).first().translation) >= 300_000


def test_dictionary_replies(spark):
    df = spark.createDataFrame([('{"A": "1", "status": "ok", "B": "2',), ("{'A': 'x'}",)], "raw string")
    assert [[tuple(e) for e in r.e] for r in df.select(J.fallback_entries(F.col("raw")).alias("e")).collect()] == [[("A", "1")], [("A", "x")]]


CACHE = "type string, key string, cache_name string, content_hash string, created_at double, expiry_time double, ttl_hours double"


def test_cache(spark):
    rows = [("s", "1", "n1", "h", 0.0, 10.0, 1.0), ("s", "2", "n2", "h", 1.0, 20.0, 1.0), ("g", "3", "n3", "g", 0.0, None, None), ("uploaded_files", "4", "n4", "u", 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, CACHE)
    assert {r.key for r in cache.live(df, 10.0).collect()} == {"2", "3", "4"}
    wanted = spark.createDataFrame([("h",), ("z",), ("z",)], "content_hash string")
    assert {(r.content_hash, r.cache_name) for r in cache.lookup(wanted, df, 10.0).collect()} == {("h", "n2"), ("z", None)}
    assert [r.content_hash for r in cache.to_create(wanted, df, 10.0).collect()] == ["z"]
    assert {(r.type, r.total, r.active) for r in cache.statistics(df, 10.0).collect()} == {("s", 2, 1), ("g", 1, 1), ("uploaded_files", 1, 1), (None, 4, 3)}
    newer = spark.createDataFrame([("s", "1", "again", "h", 5.0, 30.0, 1.0)], CACHE)
    assert {r.cache_name for r in cache.register(df, newer).collect()} == {"again", "n2", "n3", "n4"}


def test_models(spark):
    rows = [("b-gemini-1.5", ["generateContent"], 1000000, None), ("a-vision", ["generateContent"], 1, 2), ("aqa", ["generateAnswer"], 1, 1)]
    got = models.listing(spark.createDataFrame(rows, "name string, methods array<string>, input_token_limit long, output_token_limit long"))
    assert [(r.name, r.inputs, r.features, r.input_limit, r.output_limit) for r in got.collect()] == [
        ("a-vision", "文本, 图像", "标准功能", "1", "2"), ("b-gemini-1.5", "文本, 图像, 音频, 视频 (多模态)", "大上下文", "1,000,000", "N/A"),
    ]
    assert models.markdown_table(got).first().table.count("\n") == 3


@pytest.mark.parametrize("name", ["latest_segments", "translated_counts", "preamble", "clear_preamble"])
def test_status_on_empty_tables(spark, name):
    assert getattr(status, name)(segments(spark, [{}]).where("false")).count() == 0
