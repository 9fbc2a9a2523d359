"""Exports and books written here, read by Spark."""

import gzip
import io
import json
import zipfile

from galley.sources import archives


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as held:
        for name, body in entries.items():
            held.writestr(name, body)
    return out.getvalue()


def test_exports(spark, tmp_path):
    one = gzip.compress(json.dumps({"name": "Leek pie"}).encode())
    files = {
        "all.paprikarecipes": zipped({"a.paprikarecipe": one, "b.paprikarecipe": one, "photo.jpg": b"x"}),
        "single.paprikarecipe": one,
        "pages.zip": zipped({"r/one.html": "<p>Plum cake</p>", "r/": ""}),
        "page.html": b"<p>Rye bread</p>",
        "broken.zip": b"PK\x03\x04 no archive",
        "cut.paprikarecipe": one[:20],
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    rows = archives.read_exports(spark.read.format("binaryFile").load(f"file://{tmp_path}")).collect()
    got = sorted((r["path"].rpartition("/")[2], r["entry"], r["kind"]) for r in rows if r["issue"] is None)
    assert got == [
        ("all.paprikarecipes", "a.paprikarecipe", "json"), ("all.paprikarecipes", "b.paprikarecipe", "json"), ("page.html", "page.html", "html"),
        ("pages.zip", "r/one.html", "html"), ("single.paprikarecipe", "single.paprikarecipe", "json"),
    ]
    assert {json.loads(r["body"])["name"] for r in rows if r["kind"] == "json"} == {"Leek pie"}
    assert sorted(r["path"].rpartition("/")[2] for r in rows if r["issue"]) == ["broken.zip", "cut.paprikarecipe"]


def test_bounds_give_an_issue(spark, monkeypatch):
    monkeypatch.setattr(archives, "MAX_BYTES", 100)
    for body in (zipped({"a.html": "x" * 101}), zipped({"a.paprikarecipe": gzip.compress(b"y" * 60), "b.paprikarecipe": gzip.compress(b"y" * 60)})):
        try:
            list(archives._recipes("f.zip", body))
        except ValueError as problem:
            assert str(problem) == "too large"
        else:
            raise AssertionError("nothing was said")
    assert [r["issue"] for r in archives.read_exports(spark.createDataFrame([("p", None)], "path string, content binary")).collect()] == ["no content"]
    assert archives.read_books(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_books(spark):
    book = zipped(
        {
            "META-INF/container.xml": "<container><rootfiles><rootfile full-path='OPS/book.opf'/></rootfiles></container>",
            "OPS/book.opf": "<package xmlns='http://www.idpf.org/2007/opf'><manifest><item id='two' href='b%20two.xhtml'/><item id='one' href='one.xhtml'/></manifest>"
            "<spine><itemref idref='one'/><itemref idref='gone'/><itemref idref='two'/></spine></package>",
            "OPS/one.xhtml": "<body><h2 class='t'>Leek <i>pie</i></h2><div class='list'><p class='ing'>2 leeks &amp; salt</p><p> </p></div></body>",
            "OPS/b two.xhtml": "<body><table><tr><td>1 cup</td></tr></table><p>Bake<br/>well.</body>",
        }
    )
    rows = archives.read_books(spark.createDataFrame([("b", book), ("c", b"none")], "path string, content binary")).orderBy("path", "place").collect()
    assert [(r["place"], r["kind"], r["level"], r["text"], r["classes"], r["cell"]) for r in rows if r["path"] == "b"] == [
        (0, "heading", 2, "Leek pie", "t", False), (1, "text", 0, "2 leeks & salt", "ing list", False), (2, "text", 0, "1 cup", "", True), (3, "text", 0, "Bake well.", "", False),
    ]
    assert rows[-1]["issue"] and rows[-1]["place"] is None
