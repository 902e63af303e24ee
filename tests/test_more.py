import pytest
from pyspark.sql import functions as F

from versoflow import __main__ as cli
from versoflow.functions import prompts as P
from versoflow.functions import render as R
from versoflow.functions import repair as J
from versoflow.operators import cache, translate
from versoflow.sources import epub, state


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"a": " x ", "id": "1", "b": ""}', [("a", "x")]), ('[{"id": "1", "a": "x"}, {"b": "y"}]', [("a", "x"), ("b", "y")]), ('[["a", "x"], ["b"], ["c", "z", "q"]]', [("a", "x"), ("c", "z")]),
        ('```json\n{"a": "x"}\n```', [("a", "x")]), ('{"a": "x", "b": "y', [("a", "x")]), ("nothing", []), (None, []), ("[1, 2]", []),
    ],
)
def test_flat_entries(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(J.flat_entries(F.col("raw")).alias("e")).first().e
    assert [tuple(x) for x in got or []] == want


def test_prompts(spark):
    df = spark.createDataFrame([("ctx", "[]", None), (" ", "[]", "- a: b")], "c string, i string, g string")
    a, b = (r.p for r in df.select(P.text_prompt("c", "i", "g").alias("p")).collect())
    assert "ctx" in a and "translations" not in a and P.BEGINNING in b and b.endswith("Passages:\n[]") and "- a: b" in b
    got = df.select(P.system_instruction("c", None, "g").alias("s")).collect()
    assert got[0].s.endswith("Role: ctx") and got[1].s.endswith("- a: b")


def test_wrapped_parts(spark):
    df = spark.createDataFrame([("<h2>t</h2><hr/><p>a</p><hr /><p>b</p>", [3, 4], ["c<1", None])], "h string, p array<int>, c array<string>")
    got = df.select(R.wrapped_parts("h", F.col("p"), F.col("c")).alias("w")).first().w
    assert got.startswith("<h2>t</h2><hr/><div") and "P4</span><p>a</p></div><hr /><div" in got and "c&lt;1" in got and "P5</span><p>b</p>" in got
    page = df.select(R.html_page("h", F.lit("A & B"), F.lit("C")).alias("w")).first().w
    assert "<title>A &amp; B - C</title>" in page


def test_state_files(spark, tmp_path):
    (tmp_path / "t.md").write_text("x" * 30 + "\nlast line")
    assert state.recovered_context(spark, str(tmp_path / "t.md"), 12) == "xx\nlast line" and state.recovered_context(spark, str(tmp_path / "no")) == ""
    assert state.reset(spark, str(tmp_path / "t.md")) and not state.reset(spark, str(tmp_path / "t.md"))


def test_glossary_hash_ignores_order(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2")], "term string, translation string")
    assert cache.glossary_hash(a).first() == cache.glossary_hash(a.orderBy(F.desc("term"))).first()


def test_counters(spark):
    df = spark.createDataFrame([("ok",), ("[Failed: x]",)], "translated_text string")
    assert tuple(translate.run_counters(df, 4.0).first()) == (2, 1, 0.5)


def test_command_line(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(epub.write_epub([("One", "<p>Hello there.</p>")], "B"))
    cli.main([str(tmp_path / "b.epub"), "--out", str(tmp_path / "out"), "--backend", "upper"])
    assert "HELLO THERE." in "".join(p.read_text() for p in (tmp_path / "out").rglob("*.txt"))
