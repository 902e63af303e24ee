import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versoflow.functions import render as R
from versoflow.functions import text as T


def value(spark, text, f, kind="string"):
    return spark.createDataFrame([(text,)], f"t {kind}").select(f("t").alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, want",
    [("  a b　", "a b"), ("\r\n x \xa0", "x"), ("", ""), (None, None), (" \x85\t", "")],
)
def test_strip(spark, text, want):
    assert value(spark, text, T.strip) == want


@pytest.mark.parametrize("text, want", [(None, True), ("", True), (" \n　", True), ("a", False), ("。", False)])
def test_blank(spark, text, want):
    assert value(spark, text, T.is_blank) is want


@pytest.mark.parametrize(
    "text, translated, success",
    [
        ("ok", True, True), ("", False, False), (None, False, False), ("  ", False, True), ("[Failed: x]", True, False), ("x Failed]", True, False),
        ("[Translation Failed]", False, False), ("a [Translation Failed - b", False, True), ("[Failed: Blocked y]", True, False),
    ],
)
def test_two_views_of_done(spark, text, translated, success):
    assert value(spark, text, T.is_translated) is translated
    assert value(spark, text, T.is_success) is success


def test_chinese_and_cjk(spark):
    assert value(spark, "あ", T.has_chinese) is False and value(spark, "あ", T.has_cjk) is True and value(spark, "字", T.has_chinese) is True


def test_urls(spark):
    assert value(spark, "a%20b+c.xhtml", T.url_unquote) == "a b+c.xhtml"
    assert value(spark, "a%zz", T.url_unquote) == "a%zz"
    assert value(spark, "x.html#s", T.strip_fragment) == "x.html"


def test_uid(spark):
    df = spark.createDataFrame([("Hello, World - X!", 3), ("!!", 4)], "t string, i int")
    assert [r.u for r in df.select(T.toc_uid("t", F.col("i")).alias("u")).collect()] == ["toc_hello_world_x_3", "toc_item_4"]


def test_code_fence(spark):
    assert value(spark, "```json\n[1]\n```", T.strip_code_fence) == "[1]\n"
    assert value(spark, "[1]", T.strip_code_fence) == "[1]"


def test_inline_markdown(spark):
    got = value(spark, "**a** *b* ~~c~~ `d` [e](f) __g__ _h_", T.inline_markdown_to_html)
    assert got == '<strong>a</strong> <em>b</em> <del>c</del> <code>d</code> <a href="f">e</a> <strong>g</strong> <em>h</em>'


def brute_similarity(a, b):
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    if (len(a) < 50 or len(b) < 50) and short in long:
        return len(short) / len(long)
    cjk = any("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in a + b)
    x, y = (set(s.replace(" ", "")) if cjk else set(s.lower().split()) for s in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("ab 狗花c", max_size=60), st.text("ab 狗花c", max_size=60)), min_size=1, max_size=40))
def test_similarity_against_brute_force(spark, pairs):
    rows = [(k, " ".join(a.split()), " ".join(b.split())) for k, (a, b) in enumerate(pairs)]
    got = spark.createDataFrame(rows, "k int, a string, b string").select("k", "a", "b", T.similarity("a", "b").alias("s"), T.similarity("b", "a").alias("r")).collect()
    for r in got:
        assert r.s == pytest.approx(brute_similarity(r.a, r.b)) and r.s == pytest.approx(r.r) and 0 <= r.s <= 1


def test_equal_lengths_are_not_contained(spark):
    df = spark.createDataFrame([("abcdefghij klm", "zyxwvutsrq pon")], "a string, b string")
    assert df.select(T.similarity("a", "b").alias("s")).first().s == 0.0


def test_last_segment(spark):
    assert value(spark, "🔖 **Segment 4** x 🔖 **Segment 12**", T.last_segment_id) == 12
    assert value(spark, "### Segment 7", T.last_segment_id) == 7
    assert value(spark, "none", T.last_segment_id) == -1


def test_abridged_and_files(spark):
    assert value(spark, "x" * 1001, T.abridged) == "x" * 1000 + "..."
    assert value(spark, 'a/b: "c"?', T.clean_filename) == "ab_c"
    assert value(spark, "p/x.PNG", T.mime_type) == "image/png"


@pytest.mark.parametrize(
    "text, want",
    [("a\\nb", "a\nb"), ("x\r\n   y", "x\n\xa0\xa0y"), ("a　　b", "a  b"), ("a\n\n\n\nb", "a\n\nb"), (None, ""), ("  q", "q"), ("a    b", "a  b")],
)
def test_clean_text(spark, text, want):
    assert value(spark, text, R.clean_text) == want


def test_chapters(spark):
    html = "<p>pre</p><h2>📚 One</h2><p>a</p><h3></h3><p>b</p>"
    got = value(spark, html, R.chapters_of)
    assert [(c.title, c.html) for c in got] == [("前言", "<p>pre</p>"), ("One", "<h2>📚 One</h2><p>a</p>"), ("章节 3", "<h3></h3><p>b</p>")]
    assert [c.title for c in value(spark, "", R.chapters_of)] == ["全文"]
    assert value(spark, "<BODY x>in</BODY>", R.body_of) == "in"


def test_marks(spark):
    md = "\n\n###### --- 原文第 3 页 --- \n\nx\n\n###### --- 原文第 4 页 --- \n\ny"
    assert value(spark, md, R.page_numbers) == [3, 4]
    assert value(spark, md, R.without_marks) == "\n\n<!-- PAGE_MARKER_0 -->\n\nx\n\n<!-- PAGE_MARKER_1 -->\n\ny"
    assert value(spark, "<h2>a</h2>", R.heading_spacing) == '<h2 data-toc-level="2" style="margin-top: 0.20em;">a</h2>'


def test_golden_markdown(spark):
    rows = [
        (1, 0, "Hi", "你好\n# H", True, "Title", 0, 2, "text", None), (1, 1, "b", "译文", False, "Title", 4, 2, "text", None), (1, 2, "", "cap", False, "", 5, 1, "image", "i.jpg"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, segment_id long, original_text string, translated_text string, is_new_chapter boolean, chapter_title string, page_index int, toc_level int, content_type string, image_path string")
    got = [r.markdown for r in R.render_segments(df, use_breadcrumb=False).orderBy("segment_id").collect()]
    assert got[0] == "\n\n### 📖 Title\n\n你好\n\n# H\n\n\n---"
    assert got[1] == "\n\n###### --- 原文第 5 页 --- \n\n译文\n\n---"
    assert got[2] == "\n\n![Segment 2](i.jpg)\n> 💡 **图注/内容译文**\n> cap\n\n\n---"
    both = R.render_segments(df, retain_original=True, page_markers=False).orderBy("segment_id").collect()[1].markdown
    assert both == '<span class="translated">译文</span>\n<span class="original">b</span>\n<hr class="bilingual-separator">\n\n\n---'
