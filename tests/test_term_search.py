"""Misspelt terms against a full scan, and the client's search against plain Python."""

import math
import random
import re

from pyspark.sql import functions as F

from galley.operators import term_search as ts


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def allowed(term):
    return 2 if len(term) >= 8 else 1 if len(term) >= 5 else 0


def words(rng, n):
    """Words of two letters only, so that most are near others; some very long."""
    out = {"".join(rng.choices("ab", k=rng.randint(1, 14))) for _ in range(n)}
    base = "".join(rng.choices("abc", k=300))
    return sorted(out | {base, base[1:], base[:150] + base[151:], base[:7] + "x" + base[8:-1], base + "zz", base[::-1], "é漢字かなカナ漢字", "é漢字かなカナ漢"})


def test_near_terms_against_a_full_scan(spark):
    rng = random.Random(3)
    asked, known = words(rng, 150), words(random.Random(5), 250) + words(rng, 10)
    row = lambda xs, c: spark.createDataFrame([(x, 1) for x in [*xs, None, *xs[:3]]], f"{c} string, k int").repartition(3)
    got = {tuple(r) for r in ts.near_terms(row(asked, "searched"), row(known, "term")).collect()}
    want = {(a, b, d) for a in asked for b in set(known) if a != b and (d := levenshtein(a, b)) <= allowed(a)}
    assert got == want and len(got) > 400
    fixed = {tuple(r) for r in ts.near_terms(row(asked, "searched"), row(known, "term"), F.lit(2)).collect()}
    assert fixed == {(a, b, d) for a in asked for b in set(known) if a != b and (d := levenshtein(a, b)) <= 2}
    assert ts.near_terms(row([], "searched"), row(known, "term")).count() == 0


def plain_search(docs, queries, boosts):
    terms = lambda t: [x for x in re.split(r"[\s!-#%-*,-/:;?@\[-\]_{}]+", (t or "").lower()) if x]
    held = {}
    for d in docs:
        for f in boosts:
            held.setdefault(f, []).append((d["id"], terms(d[f])))
    mean = {f: sum(len(set(t)) for _, t in rows) / len(rows) for f, rows in held.items()}
    known = {t for rows in held.values() for _, ts_ in rows for t in ts_}
    out = []
    for q, text in queries:
        scores, found, asked = {}, {}, terms(text)
        for s in asked:
            for term in known:
                d = levenshtein(s, term)
                if term == s:
                    w = 1.0
                elif term.startswith(s) and len(s) >= 2:
                    w = 0.7 * len(term) / (len(term) + 0.3 * (len(term) - len(s)))
                elif d <= allowed(s):
                    w = 0.3 * len(term) / (len(term) + d)
                else:
                    continue
                for f, rows in held.items():
                    with_it = [(i, t) for i, t in rows if term in t]
                    idf = math.log(1 + (len(rows) - len(with_it) + 0.5) / (len(with_it) + 0.5))
                    for i, t in with_it:
                        n = t.count(term)
                        part = n * 2.2 / (n + 1.2 * (0.3 + 0.7 * len(set(t)) / mean[f]))
                        scores[i] = scores.get(i, 0) + w * boosts[f] * idf * (0.5 + part)
                        found.setdefault(i, set()).add(s)
        whole = {i for i in scores if found[i] == set(asked)}
        kept = {i: round(scores[i] * len(found[i]), 6) for i in whole or scores}
        order = sorted((i for i in kept if kept[i] >= 0.15 * max(kept.values())), key=lambda i: (-kept[i], i))
        out += [(q, i, kept[i], k) for k, i in enumerate(order, 1)]
    return sorted(out)


def test_search_against_plain_python(spark):
    rng = random.Random(9)
    pool = "carnitas carnita tacos taco slow cooker pork porks chicken chiken soup soups soupy lemon lemons tart tarts a of the x y".split()
    pick = lambda n: None if rng.random() < 0.1 else " ".join(rng.choices(pool, k=rng.randint(0, n)))
    docs = [{"id": k, "title": pick(4), "notes": pick(9), "tags": pick(3)} for k in range(80)]
    queries = [("a", "carnitsa taco"), ("b", "chicken, SOUP"), ("c", "zebra"), ("d", None), ("e", "so"), ("f", "tart tart lemons"), ("g", "zebra pork"), ("h", "x")]
    boosts = {"title": 6.0, "tags": 3.0, "notes": 1.0}
    frame = spark.createDataFrame([(d["id"], d["title"], d["tags"], d["notes"], 1, 1) for d in docs], "id int, title string, tags string, notes string, term int, size int")
    asked = spark.createDataFrame(queries, "query string, text string")
    got = sorted((r["query"], r["id"], r["score"], r["rank"]) for r in ts.search(frame, asked, boosts).collect())
    want = plain_search(docs, queries, boosts)
    assert [(q, i) for q, i, _, _ in got] == [(q, i) for q, i, _, _ in want]
    assert all(abs(a[2] - b[2]) < 1e-5 for a, b in zip(got, want, strict=True))
    assert {q for q, *_ in got} == {"a", "b", "e", "f", "g", "h"}
    assert ts.search(frame.limit(0), asked, boosts).count() == 0


def test_foods_for_infants_and_from_restaurants_come_later(spark):
    from galley.operators import search

    rows = [(1, "Peas, raw", "Vegetables", True), (2, "Babyfood, peas", "Vegetables", False), (3, "Peas, raw", "Fast Foods", False), (4, "Peas, raw", None, None), (5, "Peas, fat added", "Vegetables", False)]
    docs = spark.createDataFrame(rows, "id int, title string, category string, with_portions boolean")
    got = {r["id"]: r["score"] for r in search.all_then_any(docs, ["peas"], {"title": 5.0}, "title").collect()}
    assert sorted(got, key=got.get) == [1, 4, 3, 2, 5] or sorted(got, key=got.get)[:2] == [1, 4]
    assert round(got[4] - got[1], 6) == 0.3 and round(got[3] - got[4], 6) == 4.0 and got[2] > got[4] + 4


def test_alias_tiers(spark):
    from galley.operators import search

    aliases = spark.createDataFrame([("basil", 1), ("chicken thigh, boneless", 2), ("Large Eggs", 3), ("egg", 4), ("crème fraîche", 5)], "name string, food int")
    said = ["Fresh basil", "boneless chicken thighs", "eggs", "Organic eggs", "gluten-free basil (dried)", "creme fraiche", "vegan", "", None, "egg white", "large egg"]
    names = spark.createDataFrame([(k, x) for k, x in enumerate([*said, "eggs"])], "k int, name string")
    got = {r["k"]: (r["food"], r["tier"]) for r in search.alias_lookup(names, aliases).collect()}
    assert [got[k] for k in range(12)] == [
        (1, "plain"), (2, "any order"), (4, "exact"), (4, "exact"), (1, "exact"), (5, "exact"), (None, None), (None, None), (None, None), (None, None), (3, "exact"), (4, "exact"),
    ]
