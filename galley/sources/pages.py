"""What pages say of themselves: meta tags and microdata."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions.text import decoded
from galley.sources.workers import ship


def page_metadata(pages: DataFrame) -> DataFrame:
    """pages with title, lang, image and site: the title element, the language, and og:image and og:site_name; null if missing."""
    tag = lambda pattern: F.nullif(F.regexp_extract(F.col("html"), f"(?is){pattern}", 1), F.lit(""))

    def meta(name: str) -> object:
        head = rf"""<meta\b[^>]*(?:property|name)\s*=\s*["']{re.escape(name)}["'][^>]*"""
        return F.coalesce(tag(head + r"""content\s*=\s*["']([^"']*)"""), tag(rf"""<meta\b[^>]*content\s*=\s*["']([^"']*)["'][^>]*(?:property|name)\s*=\s*["']{re.escape(name)}["']"""))

    return pages.select(
        *[c for c in pages.columns if c not in ("title", "lang", "image", "site")],
        decoded(tag(r"<title\b[^>]*>(.*?)</title")).alias("title"),
        F.lower(tag(r"""<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""")).alias("lang"),
        meta("og:image").alias("image"),
        meta("og:site_name").alias("site"),
    )


class _Items(HTMLParser):
    """The itemprop values below the first itemscope of a type."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, kind: str) -> None:
        super().__init__(convert_charrefs=True)
        self.kind, self.depth, self.root, self.open, self.found = kind, 0, None, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        void = tag in self.VOID
        if not void:
            self.depth += 1
        if self.root is None and "itemscope" in named and (named.get("itemtype") or "").rstrip("/").endswith("/" + self.kind):
            self.root = self.depth
            return
        if self.root and self.depth > self.root - void and named.get("itemprop"):
            value = named.get("content") or named.get("datetime") or named.get("src") or named.get("href")
            for name in named["itemprop"].split():
                if value is not None or void:
                    self.found.append((name, value or ""))
                else:
                    self.open.append((self.depth, name, []))

    def handle_data(self, data: str) -> None:
        for _, _, parts in self.open:
            parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.VOID:
            return
        while self.open and self.open[-1][0] >= self.depth:
            _, name, parts = self.open.pop()
            self.found.append((name, " ".join("".join(parts).split())))
        if self.root == self.depth:
            self.root = 0  # one item of the page is enough
        self.depth -= 1


def microdata(page: str, kind: str) -> list[tuple[str, str]]:
    """(property, value) of the first item of a type on a page, in page order of their ends."""
    parser = _Items(kind)
    parser.feed(page)
    parser.close()
    return parser.found


def microdata_rows(pages: DataFrame, kind: str = "Recipe") -> DataFrame:
    """page_id, place, property, value of each page's first item of a type; pages without one have no rows."""
    ship(pages.sparkSession)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, n, *x) for p, h in zip(frame["page_id"], frame["html"], strict=True) for n, x in enumerate(microdata(h or "", kind))]
            if rows:
                yield pd.DataFrame(rows, columns=["page_id", "place", "property", "value"])

    return pages.select("page_id", "html").mapInPandas(scan, "page_id long, place int, property string, value string")


def clipboard_text(page: str, most: int = 50_000) -> str:
    """Pasted HTML as text: a line for each block, list items with a dash, without scripts and styles."""
    bare = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", "", page)
    bare = re.sub(r"(?i)<li\b[^>]*>", "\n- ", bare)
    bare = re.sub(r"(?i)</?(?:p|div|h[1-6]|ul|ol|tr|table|section|article|br)\b[^>]*>", "\n", bare)
    lines = (" ".join(x.split()) for x in html.unescape(re.sub(r"<[^>]+>", "", bare)).split("\n"))
    return "\n".join(x for x in lines if x)[:most]
