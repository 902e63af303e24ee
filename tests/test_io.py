import io
import json
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from versoflow import config, errors, schemas
from versoflow.functions import html as H
from versoflow.operators import translate
from versoflow.sources import epub, pages, readers, sinks, state
from versoflow.streaming import resume, ttl

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers don't have the tests


def test_settings(tmp_path):
    s = config.Settings(batch_size=20, service="openai")
    assert s.effective_batch_size == 3 and config.Settings(service="gemini", batch_size=9).effective_batch_size == 4
    assert config.safe_batch_size(20, 2000, "other") == 20 and config.safe_batch_size(20, 40_000, "other") == 2
    for bad in ({"batch_size": 0}, {"batch_size": 21}, {"log_level": "loud"}, {"document_path": "a.doc"}, {"page_range": "5-2"}):
        with pytest.raises(errors.ConfigError):
            config.Settings(**bad)
    assert config.parse_page_range("[2, 5]") == config.parse_page_range("2-5") == config.parse_page_range("2,5") == (2, 5)
    assert config.parse_page_range(None) is None
    assert config.parse_margins("0.1, 0 0 0.2") == (0.1, 0.0, 0.0, 0.2)
    with pytest.raises(errors.ConfigError):
        config.parse_margins("1,0,0,0")
    assert config.crop_box(100, 200, (0.1, 0.1, 0.1, 0.1)) == pytest.approx((10, 20, 90, 180)) and config.crop_box(10, 10, (0.6, 0, 0.6, 0)) == (0, 0, 10, 10)
    (tmp_path / ".env").write_text("# c\nPROCESSING__BATCH_SIZE=7\nRETAIN_ORIGINAL=true\nOTHER=1\nlog_level='debug'\n")
    got = config.Settings.from_env_file(str(tmp_path / ".env"))
    assert (got.batch_size, got.retain_original, got.log_level, got.extra) == (7, True, "DEBUG", {"OTHER": "1"})
    assert config.Settings.preset("careful").with_(batch_size=2).batch_size == 2
    assert config.chat_endpoint("localhost:11434") == "http://localhost:11434/v1/chat/completions" and config.chat_endpoint("https://x.y/v1/") == "https://x.y/v1/chat/completions"
    assert not config.Settings(document_path="a.epub").page_markers
    assert str(errors.SourceError("m", path="p")) == "m (path='p')"


HTML = """<html><body><nav>skip</nav><h1>Head</h1><p>One <b>two
<p>Three<script>x = "</p>";</script></p><ul><li><p>Item</p></li></ul><blockquote><p>Q</p></blockquote></body></html>"""


def test_html():
    assert H.html_blocks(HTML) == [("h1", "Head"), ("p", "One two"), ("p", "Three"), ("li", "Item"), ("p", "Item"), ("blockquote", "Q"), ("p", "Q")]
    assert H.html_blocks(None) == [] and H.html_text(None) == "" and H.html_text("<style>a</style><p>b</p>c") == "b\n\nc"
    out, n = H.replace_blocks(HTML, {"Head": "**Kopf**", "Item": "Ding", "Q": "F & G"})
    assert n == 3 and "<h1><strong>Kopf</strong></h1>" in out and "<li><p>Ding</p></li>" in out and "F &amp; G" in out and 'x = "</p>";' in out
    both, _ = H.replace_blocks("<p>a</p>", {"a": "b"}, True)
    assert both == '<p><span class="translated">b</span><br/><span class="original">a</span></p>'


def test_epub_round_trip(spark, tmp_path):
    path = tmp_path / "in" / "b.epub"
    path.parent.mkdir()
    path.write_bytes(epub.write_epub([("Ch & 1", "<h2>Ch 1</h2><p>Hello there.</p>"), ("Two", "<p>More.</p>")], "A <book>"))
    (tmp_path / "in" / "bad.epub").write_bytes(b"no zip")
    files = epub.read_epubs(spark, str(path.parent))
    assert [r.content for r in epub.units(files).orderBy("pos").collect()] == ["Ch 1", "Hello there.", "More."]
    assert [(r.level, r.title, r.key) for r in epub.contents(files).orderBy("ord").collect()] == [(1, "Ch & 1", "chapter_0001.xhtml"), (1, "Two", "chapter_0002.xhtml")]
    assert {(r.media_type, r.n) for r in epub.resources(files).collect()} == {("application/xhtml+xml", 2), ("application/x-dtbncx+xml", 1), ("text/css", 1)}
    segs = readers.load_document(spark, str(path), cache=str(tmp_path / "cache"))
    assert [(r.segment_id, r.chapter_title, r.is_new_chapter) for r in segs.orderBy("segment_id").collect()] == [(0, "Ch & 1", True), (1, "Two", True)]
    assert readers.load_document(spark, str(path), cache=str(tmp_path / "cache")).count() == 2 and len(list((tmp_path / "cache").iterdir())) == 1
    # what is saved goes by the settings and by the contents of the file
    readers.load_document(spark, str(path), cache=str(tmp_path / "cache"), max_chunk=100)
    assert len(list((tmp_path / "cache").iterdir())) == 2
    new = epub.rewrite_epub(path.read_bytes(), {"chapter_0002.xhtml": "<p>Mehr.</p>"})
    assert zipfile.ZipFile(io.BytesIO(new)).read("OEBPS/chapter_0002.xhtml") == b"<p>Mehr.</p>" and sinks.refilled_epub(path.read_bytes(), [("chapter_0002.xhtml", "")])
    docs = epub.documents(files)
    entries = H.explode_blocks(docs.select((F.crc32("name")).alias("id"), "html"), "id").select("id", "text", F.upper("text").alias("translation"))
    assert {r.replaced for r in H.refill(docs.select(F.crc32("name").alias("id"), "html"), entries, "id").collect()} == {1, 2}
    with pytest.raises(errors.SourceError):
        readers.load_document(spark, "x.txt")


class Pages:
    """Two pages, the second of which fails."""

    def pages(self, content):
        return [(100.0, 100.0)] * 3

    def text(self, content, page, box):
        if page == 1:
            raise ValueError("broken")
        return f" page {page} {box[2]:.0f} "

    def contents(self, content):
        return [(1, "Start", 1), (2, "Sub", 3), (1, "Before", 0)]


def test_paged_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    files = pages.read_files(spark, str(tmp_path / "a.pdf"))
    got = pages.scan_pages(files, Pages(), (1, 9), (0, 0, 0.5, 0)).orderBy("pos").collect()
    assert [r.content for r in got] == ["page 0 50", "", "page 2 50"]
    segs = readers.load_document(spark, str(tmp_path / "a.pdf"), extractor=Pages()).orderBy("segment_id").collect()
    assert [(r.chapter_title, r.page_index) for r in segs] == [("Start", 0), ("Start > Sub", 2)]
    assert pages.page_images(pages.scan_pages(files, Pages()), "/x/").where("image_path like '/x/%_page_0001.jpg'").count() == 1


def test_state(spark, tmp_path):
    p = str(tmp_path / "s.json")
    assert state.read_segments(spark, p, 1) is None and state.read_checkpoint(spark, p).count() == 0
    (tmp_path / "s.json").write_text(json.dumps([{"segment_id": 3, "original_text": "a"}]))
    r = state.read_segments(spark, p, 7).first()
    assert (r.doc_id, r.segment_id, r.toc_level, r.content_type, r.is_new_chapter) == (7, 3, 1, "text", False)
    (tmp_path / "bad.json").write_text("{broken")
    assert state.read_segments(spark, str(tmp_path / "bad.json"), 1) is None
    (tmp_path / "g.json").write_text(json.dumps([{"term": "a", "translation": "b"}]))
    assert state.read_glossary(spark, str(tmp_path / "none"), str(tmp_path / "g.json")).count() == 1
    assert [m.mode_id for m in state.read_modes(spark, str(tmp_path / "none")).collect()] == ["default"]
    modes = spark.createDataFrame([("b", "B", "r", None, None), ("a", "A", "r", None, None), ("c", None, "r", None, None)], schemas.MODES)
    valid = state.valid_modes(modes)
    assert valid.count() == 2 and state.choose_mode(valid, None, "b").first().mode_id == "b" and state.choose_mode(valid, "zzz").first().mode_id == "a"


def _rows(spark, n, texts=None):
    rows = [(k, 1, k, texts[k] if texts else f"text {k}", None, False, "Title", 0, 1, "text", None) for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, doc_id long, segment_id long, original_text string, translated_text string, is_new_chapter boolean, chapter_title string, page_index int, toc_level int, content_type string, image_path string")


def test_translate_stub(spark):
    df = _rows(spark, 7, ["a \"q\" \n b", "", None, "x", "y", "z", "w"])
    got = {r.segment_id: (r.translated_text, r.route) for r in translate.translate(df, translate.Upper(), 3).collect()}
    assert got[0] == ('A "Q" \n B', "strict") and got[1][0] == got[2][0] == "[Failed: Empty response]" and got[6] == ("W", "strict")


class Broken:
    def reply(self, request):
        if request["items"][0]["id"] == 0:
            raise TimeoutError("no answer")
        return translate.Upper().reply(request)


def test_only_the_failed_batch_fails(spark):
    replies = translate.call(translate.requests(_rows(spark, 6), 3), Broken(), attempts=2, first_wait=0.0)
    assert {(r.batch_id, r.error) for r in replies.collect()} == {(1, "TimeoutError: no answer"), (2, None)}


def test_retries():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "ok"

    assert translate.with_retries(flaky, 3, sleep=waits.append) == "ok" and len(waits) == 2 and waits[1] > waits[0]


def test_markdown_sink(spark, tmp_path):
    df = _rows(spark, 3).withColumn("translated_text", F.col("original_text"))
    heads = spark.createDataFrame([(1, "T", "T2")], "doc_id long, title string, translated_title string")
    sinks.write_markdown(sinks.markdown_parts(df, heads), str(tmp_path / "md"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "md").rglob("*.txt")))
    assert text.startswith("# T2 - T\n\n---\n\n") and text.index("text 0") < text.index("text 2")
    sinks.write_new_epubs(spark.createDataFrame([("My book", "<h2>A</h2><p>x</p>")], "title string, html string"), str(tmp_path / "ep"))
    assert zipfile.ZipFile(tmp_path / "ep" / "My_book.epub").testzip() is None


def test_stream_resumes(spark, tmp_path):
    src, out, at = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "at")
    _rows(spark, 3).write.parquet(src)
    stream = lambda: spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    resume.translate_stream(stream(), translate.Upper(), out, at, 2).awaitTermination(60)
    _rows(spark, 5).where("segment_id > 2").write.mode("append").parquet(src)
    resume.translate_stream(stream(), translate.Upper(), out, at, 2).awaitTermination(60)
    got = resume.current_status(spark.read.parquet(out))
    assert {(r.segment_id, r.translated_text) for r in got.collect()} == {(k, f"TEXT {k}") for k in range(5)}


def test_ttl_stream(spark, tmp_path):
    src = str(tmp_path / "req")
    rows = [("h", "n1", "2024-01-01 00:00:00"), ("h", "n2", "2024-01-01 00:00:30"), ("h", "n3", "2024-01-01 00:02:00"), ("g", "m1", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "content_hash string, cache_name string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(src)
    stream = ttl.cache_hits(spark.readStream.schema("content_hash string, cache_name string, ts timestamp").parquet(src), 60)
    q = stream.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(20)
    q.stop()
    got = {(r.content_hash, r.cache_name, r.hit) for r in spark.table("hits").collect()}
    assert got == {("h", "n1", False), ("h", "n1", True), ("h", "n3", False), ("g", "m1", False)}


def test_navigation_document():
    import io
    import zipfile

    from versoflow.sources.epub import Container

    nav = """<html><body><nav epub:type="landmarks"><ol><li><a href="x.xhtml">Skip</a></li></ol></nav>
    <nav epub:type="toc"><ol><li><a href="a.xhtml#p">One <b>more</b></a><ol><li><a href="sub/b%20c.xhtml">Two</a></li></ol></li><li><a href="#own"> </a></li><li><a href="d.xhtml"></a></li></ol></nav></body></html>"""
    opf = """<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="n" href="text/nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine/></package>"""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr("OEBPS/c.opf", opf)
        z.writestr("OEBPS/text/nav.xhtml", nav)
    assert Container(out.getvalue()).contents() == [(1, "One more", "text/a.xhtml"), (2, "Two", "text/sub/b c.xhtml"), (1, "Untitled", "text/d.xhtml")]


def test_entry_without_the_training_data_package():
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).parent.parent)
    code = f"import sys; sys.path.insert(0, {root!r}); sys.modules['regex'] = None; sys.modules['versoflow.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'chunk_segments' in q and not [n for n in q if n.startswith('p1_')]; assert e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], timeout=120).returncode == 0


def test_refilled_containers(spark):
    from versoflow.sources import epub, refill

    one = epub.write_epub([("A", "<h2>Start</h2><p>The dogs love the old trees.</p><p>Nobody knows.</p>"), ("B", "<p>The dogs love the old trees!</p>")], "T")
    two = epub.write_epub([("C", "<p>Other words here.</p>")], "U")
    epubs = spark.createDataFrame([(1, bytearray(one)), (2, bytearray(two)), (3, bytearray(b"no container"))], "doc_id long, content binary")
    mapping = refill.mapping_of(spark.createDataFrame([("The dogs  love the old trees.", "Die Hunde *lieben* die alten Bäume."), ("Start", "Anfang"), (" ", "x"), (None, "y")], "original string, translation string"))
    got = {r.doc_id: r for r in refill.refilled_epubs(epubs, mapping).collect()}
    text = " ".join(h for _, h in epub.Container(bytes(got[1].content)).documents())
    assert got[1].replaced == 2 and "<p>Die Hunde <em>lieben</em> die alten Bäume.</p>" in text and "<h2>Anfang</h2>" in text and "Nobody knows." in text and "old trees!" in text
    assert (got[2].replaced, bytes(got[2].content)) == (0, two) and (got[3].replaced, bytes(got[3].content)) == (0, b"no container")
    assert refill.refilled_epubs(epubs.where("false"), mapping).count() == 0
    assert {r.doc_id: r.replaced for r in refill.refilled_epubs(epubs, mapping, fuzzy=False, keep_original=True).collect()} == {1: 2, 2: 0, 3: 0}
