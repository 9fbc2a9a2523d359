"""Alike sets at every threshold, and the fused search, against plain Python."""

import math
import random
import re

import pytest

from galley.operators import matching
from galley.plans.catalog_queries import QUERIES


@pytest.mark.parametrize("percent", [1, 20, 28, 50, 55, 56, 80, 100])
def test_alike_pairs_against_all_pairs(percent, spark):
    """Thresholds that no binary fraction holds, and pairs that lie on them."""
    rng = random.Random(percent)
    sets = [set(rng.sample(range(40), rng.randint(0, 30))) for _ in range(40)]
    for n in (25, 50, 100):  # a set and a part of it of exactly the percentage
        whole = set(range(100, 100 + n))
        sets += [whole, set(sorted(whole)[: n * percent // 100])]
    rows = [(k, [str(x) for x in s] + [str(x) for x in list(s)[:2]]) for k, s in enumerate(sets)]
    items = spark.createDataFrame([*rows, (900, None)], "id int, words array<string>").repartition(3)
    got = {(r["a"], r["b"]): (r["both"], r["na"], r["nb"]) for r in matching.alike_pairs(items, "words", percent).collect()}
    want = {}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                want[a, b] = (both, len(sets[a]), len(sets[b]))
    assert got == want


def test_hybrid_search_against_plain_python(spark, sf):
    """Both lists by their rules, and their fusion: 1 / (60 + rank + 1) from each list."""
    docs = [(r["doc_id"], (r["text"] or "").lower()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = []
    for k, text in docs:
        words = set(re.findall("[a-z0-9]+", text))
        best = []
        for term in ("the", "idiot"):
            scores = [1.0 if w == term else 0.8 if w.startswith(term) else 0.6 * near(term, w) for w in words]
            best.append(max([s for s in scores if s], default=0))
        if all(best):
            found.append((-round(sum(best), 3), k))
    lexical = [k for _, k in sorted(found)[:40]]
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    first = min(rows)[1]
    size = lambda v: math.sqrt(sum(x * x for x in v))
    cosines = sorted(((-round(sum(x * y for x, y in zip(v, first, strict=True)) / (size(v) * size(first)), 4), -k) for k, v in rows))[:40]
    semantic = [(-k, r) for r, (c, k) in enumerate(cosines) if not lexical or -c >= 0.35]
    fused = {}
    for k, r in [*((k, r) for r, k in enumerate(lexical)), *semantic]:
        fused[k] = fused.get(k, 0) + 1 / (60 + r + 1)
    got = QUERIES["hybrid_search"](spark, sf).collect()
    want = sorted(fused.values(), reverse=True)[:10]
    assert [round(r["score"], 6) for r in got] == [round(x, 6) for x in want]
    assert all(round(fused[r["id"]], 6) == round(r["score"], 6) for r in got) and len({r["id"] for r in got}) == len(got)


def near(a, b):
    """The block ratio of two words of about the same length, or 0 below 0.8."""
    from difflib import SequenceMatcher

    r = SequenceMatcher(None, a, b, autojunk=False).ratio() if abs(len(a) - len(b)) <= 2 and len(a) >= 4 else 0
    return r if r >= 0.8 else 0


def test_records_matched_by_address_and_then_by_content(spark):
    """The two rules one after the other over all pairs, in plain Python; titles here are equal, disjoint or share words."""
    rng = random.Random(12)
    pool = [f"food{k}" for k in range(14)]

    def records(n, first):
        out = []
        for k in range(n):
            words = rng.sample(["plum", "tart", "soup", "bean", "rye"], rng.randint(1, 3))
            names = rng.sample(pool, rng.choice([0, 2, 3, 4, 6]))
            out.append((first + k, rng.choice([None, "u1", "u2", "u3", "u4", "u5"]), rng.choice([None, "x.example", "y.example"]), " ".join(words), names))
        return out

    a, b = records(30, 0), records(34, 100)
    b += [(200 + k, None, r[2], r[3], r[4]) for k, r in enumerate(a[:6])]

    def scores(x, y):
        if not x[3] or not y[3]:
            title = 0.0
        elif x[3] == y[3]:
            title = 1.0
        else:
            from difflib import SequenceMatcher

            wx, wy = set(x[3].split()), set(y[3].split())
            title = max(SequenceMatcher(None, x[3], y[3], autojunk=False).ratio(), len(wx & wy) / len(wx | wy))
        nx, ny = set(x[4]), set(y[4])
        return title, len(nx & ny) / len(nx | ny) if nx | ny else 0.0

    want, used = {}, set()
    for rule in ("canonical_url", "title_ingredients"):
        options = []
        for x in a:
            for y in b:
                t, j = scores(x, y)
                if rule == "canonical_url":
                    fits = x[1] is not None and x[1] == y[1]
                else:
                    fits = t >= 0.85 and j >= 0.7 and not (x[2] and y[2] and x[2] != y[2])
                if fits and x[0] not in used and y[0] not in used:
                    note = "same URL but low ingredient overlap" if rule == "canonical_url" and j < 0.3 and y[4] else ""
                    options.append((-(t + j), x[0], y[0], note))
        for _, x, y, note in sorted(options):
            if x not in used and y not in used:
                want[x, y] = (rule, note)
                used |= {x, y}
    kind = "id int, url string, host string, title string, names array<string>"
    got = matching.matched_records(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect()
    assert {(r["a"], r["b"]): (r["rule"], r["note"]) for r in got} == want and len(got) == len(want)
    assert {v[0] for v in want.values()} == {"canonical_url", "title_ingredients"}
