"""Exported archives and books as rows. Files are read with Spark's ``binaryFile``; each row of a result names its file."""

from __future__ import annotations

import gzip
import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from galley.sources.workers import ship

#: Of one file: entries that are read and bytes that they may unpack to. Beyond either the file has an issue and no rows.
MAX_ENTRIES, MAX_BYTES = 2000, 50 << 20


def _unzipped(data: bytes, wanted: tuple[str, ...]) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the entries with one of the endings; a ValueError says what is too large."""
    with zipfile.ZipFile(io.BytesIO(data)) as held:
        if len(held.infolist()) > MAX_ENTRIES:
            raise ValueError("too many entries")
        left = MAX_BYTES
        for entry in held.infolist():
            if not entry.is_dir() and entry.filename.lower().endswith(wanted):
                with held.open(entry) as content:
                    body = content.read(left + 1)
                left -= len(body)
                if left < 0:
                    raise ValueError("too large")
                yield entry.filename, body


def _plain(data: bytes) -> bytes:
    """Content that may be packed with gzip."""
    if data[:2] != b"\x1f\x8b":
        return data
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as held:
        body = held.read(MAX_BYTES + 1)
    if len(body) > MAX_BYTES:
        raise ValueError("too large")
    return body


def _recipes(name: str, data: bytes) -> Iterator[tuple[str, str, str]]:
    """(entry, kind, body) of an export: what the first bytes say counts more than the name's ending."""
    if data[:4] == b"PK\x03\x04":
        left = MAX_BYTES
        for entry, body in _unzipped(data, (".paprikarecipe", ".html", ".htm")):
            body = _plain(body)
            left -= len(body)
            if left < 0:
                raise ValueError("too large")
            yield entry, "json" if entry.lower().endswith(".paprikarecipe") else "html", body.decode("utf-8", "replace")
    else:
        packed = data[:2] == b"\x1f\x8b" or name.lower().endswith((".paprikarecipe", ".paprikarecipes"))
        yield posixpath.basename(name), "json" if packed else "html", _plain(data).decode("utf-8", "replace")


def read_exports(files: DataFrame) -> DataFrame:
    """(path, entry, kind, body, issue): the recipes of exports, kind json or html, as they stand in them.

    files: path, content. A file is a zip of packed JSON or of pages, one packed JSON, or one page. What can't be read, or is
    larger than the bounds, is one row with an issue in place of an entry; null content is an issue as well.
    """
    ship(files.sparkSession)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    if content is None:
                        raise ValueError("no content")
                    rows = [(path, *row, None) for row in _recipes(path or "", bytes(content))]
                except (ValueError, OSError, EOFError, zipfile.BadZipFile) as problem:
                    rows = [(path, None, None, None, str(problem) or type(problem).__name__)]
                yield pd.DataFrame(rows, columns=["path", "entry", "kind", "body", "issue"])

    return files.select("path", "content").mapInPandas(read, "path string, entry string, kind string, body string, issue string")


# Elements that make a line of their own.
LINES = set("p li h1 h2 h3 h4 h5 h6 div td dt dd blockquote section article figcaption".split())


class _Lines(HTMLParser):
    """The innermost blocks of a page with text, in order: (kind, level, text, classes, in a cell)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.found: list[tuple] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in LINES:
            if tag == "p" and self.open and self.open[-1]["tag"] == "p":
                self.handle_endtag("p")
            classes = dict(attrs).get("class") or ""
            if self.open:
                self.open[-1]["inner"] = False
            self.open.append({"tag": tag, "classes": classes, "text": [], "inner": True})
        elif tag == "br" and self.open:
            self.open[-1]["text"].append(" ")

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[-1]["text"].append(data)

    def close(self) -> None:
        """What is still open ends with the page."""
        super().close()
        while self.open:
            self.handle_endtag(self.open[-1]["tag"])

    def handle_endtag(self, tag: str) -> None:
        if not any(block["tag"] == tag for block in self.open):
            return
        while True:
            block = self.open.pop()
            text = " ".join("".join(block["text"]).split())
            if block["inner"] and text:
                head = block["tag"][0] == "h" and block["tag"][1:].isdigit()
                around = self.open[-1]["classes"] if self.open else ""
                cell = "td" in {block["tag"], *(b["tag"] for b in self.open)}
                self.found.append(("heading" if head else "text", int(block["tag"][1:]) if head else 0, text, f"{block['classes']} {around}".strip(), cell))
            if block["tag"] == tag:
                return


def _chapters(entries: dict[str, bytes]) -> Iterator[bytes]:
    """The pages of a book in the order of its spine."""
    own = lambda element: element.tag.rpartition("}")[2]
    root = ElementTree.fromstring(entries["META-INF/container.xml"])
    package = next(e.get("full-path") for e in root.iter() if own(e) == "rootfile")
    book = ElementTree.fromstring(entries[package])
    base = posixpath.dirname(package)
    files = {e.get("id"): posixpath.normpath(posixpath.join(base, unquote(e.get("href") or ""))) for e in book.iter() if own(e) == "item"}
    for place in (e for e in book.iter() if own(e) == "itemref"):
        page = entries.get(files.get(place.get("idref"), ""))
        if page is not None:
            yield page


def read_books(files: DataFrame) -> DataFrame:
    """(path, place, kind, level, text, classes, cell, issue): the lines of EPUB books in reading order, from 0 in each.

    files: path, content. kind is heading (with its level) or text; classes are those of the line and of what holds it. A book that
    can't be read, or is larger than the bounds, is one row with an issue.
    """
    ship(files.sparkSession)
    columns = ["path", "place", "kind", "level", "text", "classes", "cell", "issue"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    if content is None:
                        raise ValueError("no content")
                    lines = []
                    for page in _chapters(dict(_unzipped(bytes(content), (".xml", ".opf", ".xhtml", ".html", ".htm")))):
                        parser = _Lines()
                        parser.feed(page.decode("utf-8", "replace"))
                        parser.close()
                        lines += parser.found
                    rows = [(path, k, *line, None) for k, line in enumerate(lines)]
                except (ValueError, KeyError, StopIteration, OSError, EOFError, ElementTree.ParseError, zipfile.BadZipFile) as problem:
                    rows = [(path, None, None, None, None, None, None, str(problem) or type(problem).__name__)]
                yield pd.DataFrame(rows, columns=columns)

    schema = "path string, place int, kind string, level int, text string, classes string, cell boolean, issue string"
    return files.select("path", "content").mapInPandas(read, schema)
