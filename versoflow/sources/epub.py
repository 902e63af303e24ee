"""EPUB containers: units, contents and resources, read with the standard library in Arrow batches; and writing them."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoflow.functions.html import html_blocks


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


class Container:
    """A parsed EPUB: manifest, reading order, contents."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        container = ElementTree.fromstring(self.zip.read("META-INF/container.xml"))
        self.package_path = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        self.root = posixpath.dirname(self.package_path)
        package = ElementTree.fromstring(self.zip.read(self.package_path))
        self.items = {e.get("id"): (unquote(e.get("href")), e.get("media-type") or "", e.get("properties") or "") for e in package.iter() if _local(e.tag) == "item"}
        self.spine = [e.get("idref") for e in package.iter() if _local(e.tag) == "itemref"]
        self.title = next((e.text or "" for e in package.iter() if _local(e.tag) == "title"), "")

    def path(self, href: str) -> str:
        return posixpath.normpath(posixpath.join(self.root, href)) if self.root else href

    def read(self, href: str) -> str | None:
        try:
            return self.zip.read(self.path(href)).decode("utf-8", "replace")
        except KeyError:
            return None

    def documents(self) -> list[tuple[str, str]]:
        """(name, html) along the spine; items that are missing or no documents are passed over."""
        out = []
        for ref in self.spine:
            href, kind, _ = self.items.get(ref, ("", "", ""))
            if "html" in kind and (text := self.read(href)) is not None:
                out.append((href, text))
        return out

    def contents(self) -> list[tuple[int, str, str]]:
        """(level, title, key) of the contents in reading order: from the NCX, else from the navigation document."""
        for href, kind, properties in self.items.values():
            if kind == "application/x-dtbncx+xml" and (text := self.read(href)):
                root = ElementTree.fromstring(text.encode())
                base = posixpath.dirname(href)
                found: list[tuple[int, str, str]] = []

                def walk(node, level: int) -> None:
                    for point in node:
                        if _local(point.tag) != "navPoint":
                            continue
                        title = next((e.text or "" for e in point.iter() if _local(e.tag) == "text"), "")
                        src = next((e.get("src") or "" for e in point if _local(e.tag) == "content"), "")
                        if src:
                            found.append((level, title or "Untitled", posixpath.normpath(posixpath.join(base, unquote(src.split("#")[0])))))
                        walk(point, level + 1)

                for nav in root.iter():
                    if _local(nav.tag) == "navMap":
                        walk(nav, 1)
                if found:
                    return found
        for href, kind, properties in self.items.values():
            if "nav" in properties.split() and (text := self.read(href)):
                page = _Navigation()
                page.feed(text)
                page.close()
                base = posixpath.dirname(href)
                found = [(level, title or "Untitled", posixpath.normpath(posixpath.join(base, unquote(src.split("#")[0])))) for level, title, src in page.found if src.split("#")[0]]
                if found:
                    return found
        return []


class _Navigation(HTMLParser):
    """Links of the contents list of a navigation document, with the depth of the list that they are in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str, str]] = []
        self.inside, self.depth, self.link, self.words = 0, 0, None, []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "nav":
            # a list without a type is the contents list
            self.inside += bool(self.inside) or (given.get("epub:type") or "toc") == "toc"
        elif self.inside and tag == "ol":
            self.depth += 1
        elif self.inside and tag == "a" and given.get("href"):
            self.link, self.words = given["href"], []

    def handle_endtag(self, tag):
        if tag == "nav" and self.inside:
            self.inside -= 1
        elif self.inside and tag == "ol":
            self.depth -= 1
        elif tag == "a" and self.link is not None:
            self.found.append((max(1, self.depth), " ".join("".join(self.words).split()), self.link))
            self.link = None

    def handle_data(self, data):
        if self.link is not None:
            self.words.append(data)


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the EPUB files at a path; the scan of all the functions below."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.conv(F.left(F.md5("content"), F.lit(15)), 16, 10).cast("bigint").alias("doc_id"))


def _mapper(schema: pa.Schema, rows_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += [(doc_id, *r) for r in rows_of(Container(content))]
                except Exception:  # a file that is no container has no rows
                    continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def units(epubs: DataFrame) -> DataFrame:
    """doc_id, pos, unit_key, page_index (null), content, content_type of every block along the spine."""
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int64()), ("unit_key", pa.string()), ("page_index", pa.int32()), ("content", pa.string()), ("content_type", pa.string())])

    def rows(c: Container):
        blocks = [(name, text) for name, html in c.documents() for _, text in html_blocks(html)]
        return [(k, name, None, text, "text") for k, (name, text) in enumerate(blocks)]

    return epubs.select("doc_id", "content").mapInArrow(_mapper(schema, rows), "doc_id bigint, pos bigint, unit_key string, page_index int, content string, content_type string")


def contents(epubs: DataFrame) -> DataFrame:
    """doc_id, ord, level, title, key; from the spine for containers that list none."""
    schema = pa.schema([("doc_id", pa.int64()), ("ord", pa.int32()), ("level", pa.int32()), ("title", pa.string()), ("key", pa.string())])

    def rows(c: Container):
        listed = c.contents() or [(1, f"Section: {name}", name) for name, _ in c.documents() if "nav" not in name.lower()]
        return [(k, *item) for k, item in enumerate(listed)]

    return epubs.select("doc_id", "content").mapInArrow(_mapper(schema, rows), "doc_id bigint, ord int, level int, title string, key string")


def resources(epubs: DataFrame) -> DataFrame:
    """doc_id, media_type, n: resources by type."""
    schema = pa.schema([("doc_id", pa.int64()), ("media_type", pa.string())])
    each = epubs.select("doc_id", "content").mapInArrow(_mapper(schema, lambda c: [(kind,) for _, kind, _ in c.items.values()]), "doc_id bigint, media_type string")
    return each.groupBy("doc_id", "media_type").agg(F.count("*").alias("n"))


def documents(epubs: DataFrame) -> DataFrame:
    """doc_id, name, html of every document along the spine."""
    schema = pa.schema([("doc_id", pa.int64()), ("name", pa.string()), ("html", pa.string())])
    return epubs.select("doc_id", "content").mapInArrow(_mapper(schema, lambda c: c.documents()), "doc_id bigint, name string, html string")


def write_epub(chapters: list[tuple[str, str]], title: str, language: str = "zh", css: str = "") -> bytes:
    """A new EPUB of (title, html) chapters."""
    from html import escape

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        names = [f"chapter_{k:04d}.xhtml" for k in range(1, len(chapters) + 1)]
        for name, (head, body) in zip(names, chapters):
            z.writestr(f"OEBPS/{name}", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(head)}</title><link rel="stylesheet" href="style.css"/></head><body>{body}</body></html>')
        z.writestr("OEBPS/style.css", css)
        items = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
        refs = "".join(f'<itemref idref="c{k}"/>' for k in range(len(names)))
        z.writestr("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title><dc:language>{language}</dc:language><dc:identifier id="id">{escape(title)}</dc:identifier></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="style.css" media-type="text/css"/>{items}</manifest><spine toc="ncx">{refs}</spine></package>')
        points = "".join(f'<navPoint id="n{k}" playOrder="{k + 1}"><navLabel><text>{escape(h)}</text></navLabel><content src="{n}"/></navPoint>' for k, ((h, _), n) in enumerate(zip(chapters, names)))
        z.writestr("OEBPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>')
    return out.getvalue()


def rewrite_epub(content: bytes, replaced: dict[str, str]) -> bytes:
    """The container with the documents in ``replaced`` (name -> html) put in place of its own."""
    c, out = Container(content), io.BytesIO()
    by_path = {c.path(name): html for name, html in replaced.items()}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for info in c.zip.infolist():
            data = by_path[info.filename].encode() if info.filename in by_path else c.zip.read(info.filename)
            z.writestr(info, data)
    return out.getvalue()
