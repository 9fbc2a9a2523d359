"""HTML extraction by wrapper inference.

A page is a stream of text blocks, each under a path of elements. Streams of the same host are aligned one after another into
a union-free regular expression: what repeats becomes a repeated group, what only some pages have an optional one, and text a
slot. Each page's blocks are then matched against its host's expression, so a slot is a place in the expression, not a path
alone. A slot is not the article if its text is the same on all pages that have it, or if it is mostly links on all of them;
lists of names of elements and classes are hints besides. Copies of a page count once. A page's main text is what its host's
wrapper takes from it.

Wrappers grow by alignment of any two, so tasks form partial ones over their pages, which merge by host in two rounds; a host
that has a third of all pages brings a small partial wrapper from each task. They go to the pages by a broadcast while they are
small, else by a join.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.sources.tables import materialise
from galley.sources.workers import ship, trimmed

TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|template|title|textarea|iframe|svg|math|select|object|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Elements that begin and end a block, elements without content, and names of what is not the article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend"}
OUTSIDE = frozenset("nav footer aside form head menu button dialog search figure-ad label fieldset".split())
HINTS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments "
    "consent cookie cookies disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination pager paywall popup promo promotion recommended related reply replies respond share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription toolbar widget widgets alert disclaimer login search tags".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
READERS = frozenset("comment comments disqus reply replies respond related recommended".split())
ROOTS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Longer paths have a hash for their beginning.
PATH = 400
#: Two streams of more cells than this are aligned between the items that either has once.
CELLS = 1_000_000
#: An expression of more items has its repeats folded again.
LONG_FORM = 64
#: A slot is the host's own text if so many different pages have it and all say the same.
SAME_ON = 3
#: Pages with the same longest blocks are copies of one, whatever date or counter they differ in.
LONGEST = 3
LINKS = 0.5
#: A table of wrappers up to this size is broadcast.
BROADCAST_BYTES = 16 << 20


def attributes(rest: str) -> tuple[str, str]:
    """What an element's attributes say: the hint that rules it out, if any, and its first class without digits."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    words = set(re.split(r"[^a-z]+", names))
    hint = min(words & HINTS, default="")
    if found.get("role", "").lower() in ROLES:
        hint = hint or "role"
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        hint = hint or "hidden"
    first = re.sub(r"[^a-z-]+", "", (found.get("class", "").lower().split() or [""])[0])
    return hint, first


def entered(where: tuple[str, bool], tag: str, hint: str) -> tuple[str, bool]:
    """Where an element's content stands, from where it is itself: ``article``, ``heading``, ``body``, ``readers`` or ``out``,
    and whether an article's root is open."""
    state, root = where
    if tag in ROOTS and hint not in READERS and (state != "out" or not root):
        return ("article", True) if state != "readers" else where
    if hint in READERS:
        state = "readers"
    elif tag in OUTSIDE or hint and tag not in ("html", "body") or tag == "header" and not root:
        state = "out" if state != "readers" else state
    elif tag == "header":
        state = "heading" if state == "article" else state
    elif state == "heading" and tag in HEADINGS:
        state = "article"
    return state, root


def place(path: str) -> str:
    """Where a block's path stands: ``article``, ``body``, or ``out`` for what is not the article."""
    return path.partition(" ")[0]


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(path, text, characters in links) of each block with text, in page order.

    A path is the block's place, a space and its elements. An element's part is its name, its first class and, behind a ``!``, the
    hint that rules it out; the parts of deep nesting are a hash, so a path has a bounded length. Elements are closed as browsers
    do for paragraphs, list items and table cells left open; an end tag without its start is ignored.
    """
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, tuple[str, bool]]] = []
    open_: Counter[str] = Counter()
    buffer: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                path, (state, _) = stack[-1][1:] if stack else ("", ("body", False))
                out.append((f"{'out' if state in ('readers', 'heading') else state} {path}", text, linked))
            buffer.clear()
        linked = 0

    def cut(at: int) -> None:
        for tag, _, _ in stack[at:]:
            open_[tag] -= 1
        del stack[at:]

    for m in TOKENS.finditer(page):
        if (text := m["text"]) is not None:
            buffer.append(text)
            if in_link:
                linked += len(text.strip())
            continue
        if m["raw"] or m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag == "a":
            in_link = not m["end"]
        if tag == "br":
            buffer.append(" ")
            continue
        block = tag in BLOCKS
        if m["end"]:
            if open_[tag]:
                flush()
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            elif block:
                flush()
            continue
        rest = m["rest"]
        hint, first = attributes(rest) if rest else ("", "")
        if block:
            flush()
            if tag in CLOSES_P and open_["p"]:
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"))
            if tag in ("li", "td", "th", "tr", "dd", "dt", "option"):
                inner = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "option": ("select",)}.get(tag, ("tr", "table"))
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in inner:
                        break
                    if stack[k][0] == tag or tag in ("td", "th", "dd", "dt") and stack[k][0] in ("td", "th", "dd", "dt"):
                        cut(k)
                        break
        if tag in VOID:
            continue
        if block or hint or tag == "span" or tag in OUTSIDE:
            if hint and not block:
                flush()
            above, where = stack[-1][1:] if stack else ("", ("body", False))
            element = tag + (f".{first}" if first else "") + (f"!{hint}" if hint else "")
            if len(above) > PATH:
                above = f"#{hashed(above):08x}"
            stack.append((tag, f"{above}/{element}", entered(where, tag, hint)))
            open_[tag] += 1
    flush()
    return out


# Expressions are lists of items: a path, ["+", items] for a repeated group, ["?", items] for an optional one.


def folded(items: list, widest: int = 4) -> list:
    """Adjacent equal groups become one repeated group, shorter groups first."""
    return grouped(items, widest)[0]


def grouped(items: list, widest: int = 4) -> tuple[list, list[int]]:
    """The folded items, and how many of the items given each of them stands for."""
    sizes = [1] * len(items)
    for width in range(1, widest + 1):
        out: list = []
        held: list[int] = []
        k = 0
        while k < len(items):
            group = items[k : k + width]
            n = 1
            while len(group) == width and items[k + n * width : k + (n + 1) * width] == group:
                n += 1
            if n > 1:
                out.append(group[0] if width == 1 and group[0][0] == "+" else ["+", group])
                held.append(sum(sizes[k : k + n * width]))
                k += n * width
            elif out and width == 1 and out[-1] == ["+", [items[k]]]:
                held[-1] += sizes[k]
                k += 1
            else:
                out.append(items[k])
                held.append(sizes[k])
                k += 1
        items, sizes = out, held
    return items, sizes


def core(item: object) -> object:
    """An item without its marks, as alignment compares it."""
    while isinstance(item, list) and len(item[1]) == 1:
        item = item[1][0]
    return json.dumps(item)


def marked(a: object, b: object) -> object:
    """One item for two with the same core: repeated if either is, optional if either is."""
    marks = {m for x in (a, b) for m in marks_of(x)}
    item = a
    while isinstance(item, list) and len(item[1]) == 1:
        item = item[1][0]
    for m in ("+", "?"):
        if m in marks and not (isinstance(item, list) and item[0] == m):
            item = [m, [item]]
    return item


def marks_of(item: object) -> list[str]:
    out = []
    while isinstance(item, list):
        out.append(item[0])
        if len(item[1]) != 1:
            break
        item = item[1][0]
    return out


def anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of what either list has exactly once, rising in both: the longest such run, by patience sorting."""
    ca, cb = Counter(a), Counter(b)
    at = {x: j for j, x in enumerate(b) if cb[x] == 1}
    pairs = [(i, at[x]) for i, x in enumerate(a) if ca[x] == 1 and x in at]
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        back[k] = tails[n - 1] if n else -1
        tails[n : n + 1], ends[n : n + 1] = [k], [j]
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def parts(a: list, b: list) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, k, l): stretches a[i:j] and b[k:l] to align on their own; one pair of whole lists unless that is too much."""
    if len(a) * len(b) <= CELLS:
        yield 0, len(a), 0, len(b)
        return
    i = k = 0
    for x, y in [*anchors(a, b), (len(a), len(b))]:
        yield i, x, k, y
        if x < len(a):
            yield x, x + 1, y, y + 1
        i, k = x + 1, y + 1


def aligned(a: list, b: list) -> list:
    """The expression of two: their longest common sequence, with what either lacks as optional groups.

    Very long streams are aligned between anchors; what is too long even there has nothing in common.
    """
    if a == b:
        return a
    ka, kb = [core(x) for x in a], [core(x) for x in b]
    out: list = []
    for i, j, k, n in parts(ka, kb):
        out += stretch(a[i:j], b[k:n], ka[i:j], kb[k:n])
    return folded(out) if len(out) > LONG_FORM else out


def stretch(a: list, b: list, ka: list, kb: list) -> list:
    optional = lambda x: x if isinstance(x, list) and x[0] == "?" else ["?", [x]]
    if len(a) * len(b) > CELLS:
        return [optional(x) for x in (*a, *b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below, mine = best[i], best[i + 1], ka[i]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if mine == kb[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and ka[i] == kb[j]:
            out.append(marked(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return out


def matched(paths: list[str], form: list, cores: list | None = None) -> list[int]:
    """The item of an expression that each block of a page is in; -1 where the expression has none.

    Of all ways to match, one with the most items of the page and the most items that are not optional, the leftmost.
    """
    items, sizes = grouped(paths)
    own = [core(x) for x in items]
    cores = [core(x) for x in form] if cores is None else cores
    at = list(range(len(own)))
    if own != cores:
        worth = [1 + ("?" not in marks_of(x)) for x in form]
        at = []
        for i, j, k, n in parts(own, cores):
            at += [x if x < 0 else x + k for x in places(own[i:j], cores[k:n], worth[k:n])]
    return [k for k, n in zip(at, sizes, strict=True) for _ in range(n)]


def places(own: list, cores: list, worth: list[int]) -> list[int]:
    """For each item of a page its place in an expression, or -1, with the greatest worth in all."""
    at = [-1] * len(own)
    if len(own) * len(cores) > CELLS:
        return at
    best = [[0] * (len(cores) + 1) for _ in range(len(own) + 1)]
    for i in range(len(own) - 1, -1, -1):
        row, below, mine = best[i], best[i + 1], own[i]
        for j in range(len(cores) - 1, -1, -1):
            most = max(below[j], row[j + 1])
            row[j] = max(most, below[j + 1] + worth[j]) if cores[j] == mine else most
    i = j = 0
    while i < len(own) and j < len(cores):
        if cores[j] == own[i] and best[i][j] == best[i + 1][j + 1] + worth[j]:
            at[i] = j
            i, j = i + 1, j + 1
        elif best[i][j] == best[i][j + 1]:
            j += 1
        else:
            i += 1
    return at


class Matcher:
    """Matches pages against one host's expression; streams seen before are not matched again."""

    def __init__(self, form: list):
        self.form, self.cores, self.known = form, [core(x) for x in form], {}

    def slots(self, page: list[tuple[str, str, int]]) -> list[str]:
        """The name of the slot of each block: its item and its path."""
        paths = [path for path, _, _ in page]
        if (key := "\n".join(paths)) not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            self.known[key] = [f"{k} {path}" for k, path in zip(matched(paths, self.form, self.cores), paths, strict=True)]
        return self.known[key]


def hashed(text: str, start: int = 0) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"), start)


def slots_of(page: list[tuple[str, str, int]], names: list[str]) -> dict[str, list]:
    """For each slot of a page: least and greatest hash of its text, hashes of contents that have it, least share of links."""
    inner = [text for path, text, _ in page if place(path) != "out"] or [text for _, text, _ in page]
    content = hashed("\n".join(sorted(sorted(inner, key=lambda t: (-len(t), t))[:LONGEST])))
    found: dict[str, list[int]] = {}
    for name, (_, text, links) in zip(names, page, strict=True):
        s = found.setdefault(name, [0, 0, 0])
        s[0] = hashed(text, s[0])
        s[1] += len(text)
        s[2] += min(links, len(text))
    return {name: [h, h, [content], links / chars] for name, (h, chars, links) in found.items()}


def together(a: dict[str, list], b: dict[str, list]) -> dict[str, list]:
    """The slots of two. Copies of a page change nothing; of the contents, SAME_ON are kept, as no more are asked for."""
    out = dict(a)
    for name, (low, high, contents, links) in b.items():
        if name in out:
            lo, hi, c, k = out[name]
            out[name] = [min(lo, low), max(hi, high), sorted({*c, *contents})[:SAME_ON], min(k, links)]
        else:
            out[name] = [low, high, contents, links]
    return out


def wrapper_of(page: list[tuple[str, str, int]]) -> dict:
    """A wrapper of one page: its expression and its slots."""
    form = folded([path for path, _, _ in page])
    return {"form": form, "slots": slots_of(page, Matcher(form).slots(page))}


def labels(wrapper: dict) -> tuple[Matcher, dict[str, str]]:
    """The matcher of a wrapper, and ``article``, ``body`` or ``out`` for each of its slots, in upper case for the host's own text."""
    out = {}
    for name, (low, high, contents, links) in wrapper["slots"].items():
        where = place(name.partition(" ")[2])
        several = len(contents) >= SAME_ON
        if several and low == high or links > LINKS and (several or where == "body"):
            where = where.upper()
        out[name] = where
    return Matcher(wrapper["form"]), out


def main_text(page: list[tuple[str, str, int]], label: tuple[Matcher, dict[str, str]]) -> str:
    """The blocks in slots of the article; if the page has none, those in slots of the body.

    The host's own text among them is left out, unless the page has nothing else.
    """
    matcher, of = label
    names = matcher.slots(page)
    place_of = [of.get(name) or place(path) for name, (path, _, _) in zip(names, page, strict=True)]
    for where in ("article", "body"):
        for kind in (where, where.upper()):
            if got := [text for w, (_, text, _) in zip(place_of, page, strict=True) if w == kind]:
                return "\n".join(got)
    return ""


def expressions(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON of the expression) of each host of (host, html) rows; pages without html add nothing."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list] = {}
        seen: set[tuple] = set()
        for frame in frames:
            for host, page in zip(frame["host"], frame["html"], strict=True):
                own = folded([path for path, _, _ in blocks(page)])
                if (form := (host, json.dumps(own))) in seen:
                    continue  # aligned before
                if len(seen) < 100_000:
                    seen.add(form)
                found[host] = aligned(found[host], own) if host in found else own
        yield from rows_of(found)

    return by_host(pages.select("host", "html").mapInPandas(trimmed(partial), "host string, salt int, wrapper string"), aligned)


def rows_of(found: dict) -> Iterator[pd.DataFrame]:
    if found:
        salt = TaskContext.get().partitionId() % 64
        yield pd.DataFrame({"host": list(found), "salt": salt, "wrapper": [json.dumps(w) for w in found.values()]})


def by_host(parts: DataFrame, merged) -> DataFrame:
    """One wrapper for each host from partial ones, in two rounds."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for w in sorted(frame["wrapper"]):
            total = json.loads(w) if total is None else merged(total, json.loads(w))
        return pd.DataFrame({"host": frame["host"][:1], "wrapper": [json.dumps(total)]})

    once = parts.groupBy("host", "salt").applyInPandas(lambda f: merge(f), "host string, wrapper string")
    return once.groupBy("host").applyInPandas(lambda f: merge(f), "host string, wrapper string")


def with_wrappers(pages: DataFrame, found: DataFrame) -> DataFrame:
    size = found.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    found = found.withColumnRenamed("host", "of")
    return pages.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, F.col("host") == F.col("of"), "left")


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) of each host of (host, html) rows; pages without html add nothing.

    Two passes: the expressions, and what the slots hold on the pages matched against them.
    """
    ship(pages.sparkSession)
    pages = pages.filter("html is not null").select("host", "html")
    forms = materialise(expressions(pages), "expressions")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, dict] = {}
        matchers: dict[str, Matcher] = {}
        for frame in frames:
            for host, html_, wrapper in zip(frame["host"], frame["html"], frame["wrapper"], strict=True):
                if host not in matchers:
                    if len(matchers) > 256:
                        matchers.clear()
                    matchers[host] = Matcher(json.loads(wrapper))
                page = blocks(html_)
                own = slots_of(page, matchers[host].slots(page))
                found[host] = together(found[host], own) if host in found else own
        yield from rows_of(found)

    held = with_wrappers(pages, forms).select("host", "html", "wrapper")
    slots = by_host(held.mapInPandas(trimmed(partial), "host string, salt int, wrapper string"), together)
    both = forms.withColumnRenamed("wrapper", "form").join(slots, "host")
    return both.select("host", F.concat(F.lit('{"form": '), "form", F.lit(', "slots": '), "wrapper", F.lit("}")).alias("wrapper"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each (page_id, url, html) row; text is empty for null html or if nothing is left.

    The host is the url's, in lower case; rows whose url is null or has none share one wrapper. Character references are decoded,
    white space in a block becomes one space, and blocks are joined by line ends. Repeated rows stay; other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    held = pages.select("page_id", "url", "html", host.alias("host"))
    joined = with_wrappers(held, materialise(infer(held), "wrappers"))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[Matcher, dict[str, str]]] = {}
        for frame in frames:
            out = []
            for page, wrapper in zip(frame["html"], frame["wrapper"], strict=True):
                if not page:
                    out.append("")
                    continue
                if wrapper not in known:
                    if len(known) > 256:
                        known.clear()
                    known[wrapper] = labels(json.loads(wrapper))
                out.append(main_text(blocks(page), known[wrapper]))
            yield frame[["page_id", "url"]].assign(text=out)

    kind = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    return joined.select("page_id", "url", "html", "wrapper").mapInPandas(trimmed(batches), kind)
