"""The source divergence audit: odd rows by value, against plain Python."""

from collections import Counter, defaultdict

import pytest

from galley.llm import divergence

KIND = "doc_id long, text string, lang string, source string, term string, i int, value int, c int, shares int, n int, counts int"
CLASH = ("x", 1, 1, 1, 1, 1, 1)


def plain_audit(rows, least=3, most=200):
    """The audit in plain Python, from (text, lang, source) rows."""
    docs = [
        ("".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalpha() or ord(c) > 0x7F else " " for c in t or "").split(" "), l or "", s or "")
        for t, l, s in rows
    ]
    out = []
    for lang in {l for _, l, _ in docs}:
        held, counts = Counter(), defaultdict(Counter)
        for words, l, s in docs:
            if l == lang:
                words = [w for w in words if w]
                held.update(set(words))
                counts[s].update(words)
        kept = [w for w in held if held[w] >= least]
        total = {s: sum(c[w] for w in kept) + len(kept) for s, c in counts.items()}
        part = lambda c, n: 1 + 10**9 * (c + 1) // n
        p = {s: {w: part(c[w], total[s]) for w in kept} for s, c in counts.items()}
        every = sum(total.values()) - len(kept) * (len(total) - 1)
        q = {w: part(sum(c[w] for c in counts.values()), every) for w in kept}
        for s in counts:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in counts if o != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for name, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, name, w, v, k) for k, (w, v) in enumerate(items, 1) if name == "pair" or k <= most]
    return sorted(out)


def audited(spark, rows, **more):
    docs = spark.createDataFrame([(k, *r, *CLASH) for k, r in enumerate(rows)], KIND).repartition(3)
    return sorted(map(tuple, divergence.audit(docs, **more).collect()))


LONG = " ".join(f"Wort{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(200_000))
ROWS = [
    (None, None, None), (None, "en", "a"), ("", "en", "b"), ("12 3 --", "fr", "a"), ("one Two tWO", "en", "a"), ("one two", "en", "a"),
    ("one two", "en", "a"), ("two é É 漢字 don't", "en", None), ("é É 漢字", "en", ""), ("é É", "en", "b"), ("solo", "de", "x"), ("solo", "de", "x"),
    ("solo", "de", "x"), ("a_b a\u0000b", None, "y"), ("a b", None, "z"), ("A B", "", "z"), (LONG, "en", "long"), (LONG, "en", "a"), (LONG + " é", "en", "𝒳"),
]


@pytest.mark.parametrize("rows", [[], ROWS[:1], ROWS[:4], ROWS], ids=["empty", "null", "without terms", "odd rows"])
def test_against_plain_python(rows, spark, monkeypatch):
    assert audited(spark, rows) == plain_audit(rows)
    if len(rows) > 4:
        assert audited(spark, rows, least_docs=1, most_terms=5) == plain_audit(rows, 1, 5)


def test_counts_given_away_in_parts(spark, monkeypatch):
    """Long texts split into pieces and counts that a task gives away early are the same counts."""
    data = b"ab " * 50 + b"c" * 40 + b" ab c"
    monkeypatch.setattr(divergence, "PIECE", 16)
    assert b"".join(divergence.pieces(data)) == data and len(list(divergence.pieces(data))) > 5
    assert Counter(w for x in divergence.pieces(data) for w in x.split()) == Counter(data.split())


def test_a_language_without_terms_has_pairs_of_zero(spark):
    got = audited(spark, [("x", "en", "a"), ("y", "en", "b"), (None, "en", "c")])
    assert [r[:6] for r in got if r[1] == "a"] == [("en", "a", "pair", "b", 0, 1), ("en", "a", "pair", "c", 0, 2)]
