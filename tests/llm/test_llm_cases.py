"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import random

import pytest

from galley.llm import bpe, chat, digest, language_id, line_dedup, mixing, ngram_join, quality, toxicity, wrappers
from galley.llm.queries import tokenizer_file

KIND = (
    "doc_id long, text string, lang string, source string, n_chars long, words string, size int, score int, line_dedup int, c int, token int, "
    "taken int, fingerprint int, lang_pred int"
)
LONG = " ".join(f"w{k % 977}" for k in range(30_000)) + "x" * 20_000


def odd_rows():
    rest = (9, "x", 1, 1, 1, 1, 1, 1, 1, 1)
    return [
        (None, None, None, None, *rest),
        (1, "", "en", "s", *rest),
        (1, "a b c d e f", "en", "s", *rest),
        (1, "a b c d e f", "en", "s", *rest),
        (2, "a b c d e f", "fr", None, *rest),
        (3, " \n\t", None, "t", *rest),
        (4, LONG, "en", "t", *rest),
        (5, "é漢字 \u0000 ok\r\nΣ", "el", "t", *rest),
    ]


RUNS = {
    "language": lambda d: language_id.identify(d, language_id.fit(d)),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))),
    "fingerprint": lambda d: digest.fingerprint_documents(d, digest.corpus_ranks(d)),
    "edits": lambda d: digest.compare_with_edits(d, digest.corpus_ranks(d)),
    "join": lambda d: ngram_join.groups(d),
    "tokens": lambda d: bpe.encode_documents(d, tokenizer_file()),
    "mix": lambda d: mixing.mix(d),
    "quality": lambda d: quality.judge(d),
    "lines": lambda d: line_dedup.without_boilerplate(d),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_one_row_for_each_row(name, spark):
    for rows in ([], odd_rows()[:1], odd_rows()):
        docs = spark.createDataFrame(rows, KIND).repartition(3)
        assert RUNS[name](docs).count() == len(rows)


def test_defined_values(spark):
    docs = spark.createDataFrame(odd_rows(), KIND)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.groups(docs).collect()}
    assert got[None, 0] is None and got[1, 0] == 1 and got[1, 2] == 1 and got[2, 2] == 1 and got[3, 0] == 3
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs).collect()]
    assert kept.count((1, "a b c d e f")) == 1 and (2, "a b c d e f") not in kept
    ranks = digest.corpus_ranks(docs)
    prints = {r["text"]: r["fingerprint"] for r in digest.fingerprint_documents(docs, ranks).collect()}
    assert prints[None] == prints[""] == "0:" and digest.likeness(digest.parsed("0:"), digest.parsed("0:")) == 1
    langs = {r["text"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert langs[None] == langs[""] == ("und", 0.0)


def test_only_empty_texts_have_no_fingerprint():
    import numpy as np

    random.seed(11)
    texts = [bytes(random.choices(b"abcdefgh ijkl mnop", k=n)) for n in range(1, 400)] + [b"-" * n for n in range(60, 300, 7)] + [b""]
    ranks = digest.ranks_of(digest.class_counts(texts))
    filters, counts = digest.fingerprints(texts, ranks)
    assert [k for k, n in enumerate(counts) if not n] == [len(texts) - 1]
    a, b = digest.fingerprints([b"-" * 200], ranks)[0], digest.fingerprints([b"=" * 200], ranks)[0]
    assert digest.likeness(a, b) < 0.1 and digest.likeness(a, np.array(a)) == 1


def test_rare_toxic_expressions_count(spark):
    """A word of few toxic documents, and pairs behind words that only toxic documents have, are evidence."""
    import numpy as np

    random.seed(13)
    plain = lambda: random.choices([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], k=20)
    rows = [(k, " ".join(plain() + (["zorp"] if k < 8 and k % 2 else []) + ["wretch", "fool"] * (k % 2)), k % 2) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    rare, unknown, common = toxicity.compare(model, ["zorp", "neverseen", "waa"])[:, 1]
    assert rare > unknown + 0.3 and rare > common + 0.3
    first, second = toxicity.ids_of(model.words, toxicity.word_hashes(["wretch fool"])[0])
    assert first * (len(model.words) + 2) + second in model.pairs
    assert np.isfinite(model.ratio).all() and np.isfinite(model.single).all() and np.isfinite(model.context).all()


def test_chat_round_trip(spark):
    random.seed(3)
    pieces = ["\\", "### ", "</turn>", "\n", ": ", "a", " ", "#", "<", "user"]
    rows = [(c, t, random.choice(["user", "assistant", "a:b\\", None]), "".join(random.choices(pieces, k=random.randint(0, 9)))) for c in range(60) for t in range(4)]
    rows += [(None, 0, "assistant", None), (7, None, "user", "tie"), (7, None, "user", "tie")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    assert len(got) == 61 and all(r["roundtrip"] for r in got)
    for r in got:
        assert "".join(r["loss_texts"]) == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
    assert chat.format_conversations(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0


def test_boilerplate_goes_but_once(spark):
    line, own = "All rights reserved by us", "a text of its own number"
    rows = [(k, f"{own} {k}\n{line}\n{line}", f"s{k % 5}") for k in range(10)] + [(10, f"x y z\n{line}", None)]
    got = {r["doc_id"]: r["line_dedup"] for r in line_dedup.without_boilerplate(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert got[0]["n_removed"] == 0 and got[3]["text"] == f"{own} 3" and got[10]["text"] == "x y z"
    few = [(k, line, f"s{k % 4}") for k in range(40)]
    assert all(r["line_dedup"]["n_removed"] == 0 for r in line_dedup.without_boilerplate(spark.createDataFrame(few, "doc_id int, text string, source string")).collect())


def test_near_copies_of_one_text(spark):
    """A text and edited copies: copies may be far from each other and still be one group by the text."""
    random.seed(5)
    words = [f"w{random.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(words)]
    for k in range(60):
        w = list(words)
        for i in random.sample(range(200), 1 + k % 8):
            w[i] = f"v{random.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(197)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.groups(docs, 4, 85).collect()} == {i: find(i) for i in range(len(texts))}


def test_segment_tree_merges():
    """Against merging the leftmost pair of the least rank, one at a time."""
    random.seed(7)
    merges, n = {}, 5
    for rank in range(40):
        pair = (random.randrange(n), random.randrange(n))
        if pair not in merges:
            merges[pair] = (rank, n)
            n += 1
    for _ in range(500):
        word = [random.randrange(5) for _ in range(random.randint(0, 40))]
        plain = list(word)
        while found := [(merges[p][0], i) for i, p in enumerate(zip(plain, plain[1:])) if p in merges]:
            i = min(found)[1]
            plain[i : i + 2] = [merges[plain[i], plain[i + 1]][1]]
        assert bpe.merged(word, merges) == plain


def test_viterbi_is_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    sizes = np.array([4, 0, 6, 1])
    scores = rng.normal(size=(11, 3)).astype(np.float32)
    labels, at = language_id.viterbi(scores, sizes, 1.0), 0
    for n in sizes:
        own = scores[at : at + n]
        worth = lambda path: sum(own[i, p] for i, p in enumerate(path)) - sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        if n:
            assert worth(labels[at : at + n]) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=int(n)))), abs=1e-5)
        at += n


def test_mixed_language_spans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    texts = {r["lang"]: r["text"] for r in docs.filter("length(text) > 1500").orderBy("doc_id").collect()}
    both = texts["en"][:600] + "\n" + texts["de"][:600]
    row = language_id.identify(spark.createDataFrame([(1, both)], "doc_id int, text string"), model).first()
    long = [s for s in row["spans"] if s["end"] - s["start"] > 300]
    assert [s["lang"] for s in long] == ["en", "de"] and abs(long[1]["start"] - 601) < 60


def test_wrapper_expressions():
    a, b = ["h1", "p", "p", "p", "foot"], ["h1", "note", "p", "foot"]
    assert wrappers.folded(a) == ["h1", ["+", ["p"]], "foot"]
    assert wrappers.aligned(wrappers.folded(a), b) == ["h1", ["?", ["note"]], ["+", ["p"]], "foot"]
    assert wrappers.folded(["q", "r", "q", "r", "s"]) == [["+", ["q", "r"]], "s"]
    page = (
        "<div class=header>H</div><div><article><header><h1>T</h1><span>by x</span></header><p>a &amp;lt; b<p>c<div class='ad'>AD</div>"
        "<form>f</form><aside>x</aside><ul><li>one<li>two</ul></article><section id='comments'><article>c1</article></section></div><footer>f"
    )
    blocks = wrappers.blocks(page)
    assert wrappers.main_text(blocks, wrappers.labels(wrappers.wrapper_of(blocks))) == "T\na &lt; b\nc\none\ntwo"


def extracted(spark, pages):
    docs = spark.createDataFrame([(k, f"http://h.org/{k}", html) for k, html in enumerate(pages)], "page_id int, url string, html string")
    return [r["text"] for r in sorted(wrappers.extract(docs).collect(), key=lambda r: r["page_id"])]


def test_alignment_decides(spark):
    """The same paragraph stands before each title, under the path of the article's own; only its place in the expression tells."""
    pages = [f"<article><p>Sign our letter</p><h1>T{k}</h1><p>text {k}</p>{'<p>more</p>' * (k % 3)}</article>" for k in range(6)]
    assert extracted(spark, pages) == ["\n".join([f"T{k}", f"text {k}"] + ["more"] * (k % 3)) for k in range(6)]


def test_copies_of_a_page_keep_their_text(spark):
    page = "<div><h2>Only</h2><p>one body text</p><p>and another of it</p></div>"
    own = "Only\none body text\nand another of it"
    assert extracted(spark, [page] * 5) == [own] * 5
    others = [f"<div><ul><li>our menu</li></ul><h3>T {k}</h3></div>" for k in range(4)]
    assert extracted(spark, [page] * 4 + others) == [own] * 4 + [f"T {k}" for k in range(4)]
    dated = [f"<div><h2>Only</h2><p>one body text</p><span>{k}</span><p>and another of it</p></div>" for k in range(4)]
    assert all("Only" in t and "one body text" in t for t in extracted(spark, dated))


def test_quality_fit_separates():
    good, bad = (1, 1, 1), (0, 0, 1)
    share, right = quality.fit([(good, 900), ((1, None, 1), 50), (bad, 100)])
    assert quality.posterior(good, share, right) > 0.9 > 0.5 > quality.posterior(bad, share, right)


def test_entry_without_the_folder(tmp_path):
    """Without the subpackage and the pipeline the other queries are still there."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[2]
    shutil.copytree(root / "galley", tmp_path / "galley", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout.split()[0]) > 40


def test_entry_with_the_pipeline_left(tmp_path):
    """The pipeline alone does not hide the other queries, and a missing package is not taken for a missing folder."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[2]
    shutil.copytree(root / "galley", tmp_path / "galley", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path)
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    said = run("import __spark_entry__ as e; print(len(e.queries()))")
    assert said.returncode == 0 and int(said.stdout) > 90
    shutil.copytree(root / "galley" / "llm", tmp_path / "galley" / "llm")
    said = run("import sys; sys.modules['regex'] = None\nimport __spark_entry__")
    assert said.returncode != 0 and "regex" in said.stderr


def test_odd_pages(spark):
    kind = "page_id long, url string, html string, text string, host string, wrapper string, salt int"
    deep = "<div>" * 3000 + "deep" + "<p>y</p>" * 2000
    rows = [
        (1, "http://h.org/1", None, "t", "h", "w", 1), (2, "http://h.org/2", "", "t", "h", "w", 1), (None, None, "<p>null url", "t", "h", "w", 1),
        (4, "no host", "<p>a &lt; b</p>", "t", "h", "w", 1), (4, "no host", "<p>a &lt; b</p>", "t", "h", "w", 1), (5, "http://d.org/", deep, "t", "h", "w", 1),
        (6, "HTTP://H.org/3", "<p>x<script>no</script> \n y", "t", "h", "w", 1),
    ]
    got = wrappers.extract(spark.createDataFrame(rows, kind).repartition(3)).collect()
    text = {(r["page_id"], r["url"]): r["text"] for r in got}
    assert len(got) == len(rows) and text[1, "http://h.org/1"] == text[2, "http://h.org/2"] == ""
    assert text[4, "no host"] == "a < b" and text[None, None] == "null url" and text[6, "HTTP://H.org/3"] == "x y"
    assert text[5, "http://d.org/"] == "\n".join(["deep"] + ["y"] * 2000)
    assert wrappers.extract(spark.createDataFrame([], kind)).count() == 0


def test_pages_without_article_or_hints(spark):
    """Class names say nothing here; what all pages of the host say, and lists of links, are not the article."""
    page = "<div class=q1><a href=/a>One</a> <a href=/b>Two</a></div><div class=q2><h2>T{0}</h2><p>Body number {0}.</p>{1}</div><div class=q3>Made by us</div>"
    pages = [page.format(k, f"<p>More {k}</p>" * (k % 2)) for k in range(6)]
    assert extracted(spark, pages) == ["\n".join([f"T{k}", f"Body number {k}."] + [f"More {k}"] * (k % 2)) for k in range(6)]


def test_alignment_is_a_longest_common_sequence():
    import itertools

    random.seed(17)
    for _ in range(150):
        a, b = (random.choices("abcde", k=random.randint(0, 7)) for _ in range(2))
        common = max(n for n in range(len(a) + 1) for x in itertools.combinations(a, n) if n == 0 or is_part(x, b))
        got = wrappers.aligned(a, b)
        assert sum(not isinstance(x, list) for x in got) == common
        for own in (a, b):
            assert [x for x in got if not isinstance(x, list)] == [x for x in got if x in own and not isinstance(x, list)]
            assert is_part(own, [x[1][0] if isinstance(x, list) else x for x in got])


def is_part(a, b):
    rest = iter(b)
    return all(x in rest for x in a)


def test_long_streams_are_aligned_between_anchors():
    a = [f"a{k}" for k in range(1500)]
    b = [x for k, x in enumerate(a) if k % 10] + ["end"]
    got = wrappers.aligned(a, b)
    assert sum(not isinstance(x, list) for x in got) == len(b) - 1
    assert wrappers.matched(b[:-1], a) == [k for k in range(1500) if k % 10]


def test_kneser_ney_against_plain_python():
    """Ratios of two classes from the definition: bigram, shared bigram, continuation count, shared continuation count."""
    import math
    from collections import Counter

    import numpy as np

    random.seed(19)
    words = ["w" + c for c in "abcdefgh"]
    texts = [[random.choice(words[: 8 - 3 * y]) for _ in range(12)] for y in (0, 1) for _ in range(6)]
    label = [0] * 6 + [1] * 6
    known = {int(h): k + 2 for k, h in enumerate(np.sort(toxicity.word_hashes([" ".join(words)])[0]))}
    number = {w: known[int(toxicity.word_hashes([w])[0][0])] for w in words}
    size, counts = len(words) + 2, [Counter(), Counter()]
    for t, y in zip(texts, label):
        for before, w in zip([1, *[number[x] for x in t]], [number[x] for x in t]):
            counts[y][before, w] += 1
    packed = [((y * size + a) * size + b, n) for y in (0, 1) for (a, b), n in counts[y].items()]
    model = toxicity.smoothed(np.sort(np.array(list(known), np.uint64)), np.array([p for p, _ in packed]), np.array([float(n) for _, n in packed]))
    D = toxicity.DISCOUNT
    kinds = sorted(set(counts[0]) | set(counts[1]))
    raw = {w: sum(any(b == w for _, b in counts[c]) for c in (0, 1)) + 0.01 for w in range(size)}
    shared = {w: v / sum(raw.values()) for w, v in raw.items()}
    both = {k: (k in counts[0]) + (k in counts[1]) for k in kinds}
    total = Counter()
    for (a, _), n in both.items():
        total[a] += n

    def probability(c, a, w):
        after = Counter(b for _, b in counts[c])
        n = sum(after.values())
        own = max(after[w] - D, 0) / n + D * len(after) / n * shared[w]
        pooled = max(both.get((a, w), 0) - D, 0) / max(total[a], 1)
        rest = 1 - sum(max(v - D, 0) / max(total[a], 1) for (x, _), v in both.items() if x == a)
        seen = sum(v for (x, _), v in counts[c].items() if x == a)
        direct = max(counts[c][a, w] - D, 0) / max(seen, 1)
        left = 1 - sum(max(v - D, 0) / max(seen, 1) for (x, _), v in counts[c].items() if x == a)
        return direct + left * (pooled + rest * own)

    for k, (a, w) in enumerate(kinds):
        assert model.ratio[k] == pytest.approx(math.log(probability(1, a, w) / probability(0, a, w)), abs=1e-4)


def test_fingerprint_features_against_plain_python():
    """Entropy of each window, points of the rarest of each run, and chosen windows, one at a time."""
    import math
    from collections import Counter

    import numpy as np

    random.seed(23)
    texts = [bytes(random.choices(b"abcdefghij klmn op\n", k=n)) for n in (64, 100, 180, 260)] + [b"ab" * 90]
    W, R = digest.WIDTH, digest.RUN

    def classes(t):
        out = []
        for k in range(len(t) - W + 1):
            entropy = -sum(n / W * math.log2(n / W) for n in Counter(t[k : k + W]).values())
            out.append(digest.CLASSES * entropy / math.log2(W))
        return out

    for t in texts:
        got = digest.entropy_classes(np.frombuffer(t, np.uint8))
        assert all(abs(a - b) <= 1.01 for a, b in zip(got, classes(t), strict=True))
    ranks = digest.ranks_of(digest.class_counts(texts))
    for t in texts:
        key = [(int(ranks[c]), k) for k, c in enumerate(digest.entropy_classes(np.frombuffer(t, np.uint8)))]
        points = Counter(min(key[k : k + R])[1] for k in range(len(key) - R + 1))
        chosen = {k for k in range(len(key)) if points[k] >= digest.POINTS and key[k][0] < digest.NEVER}
        if len(key) - R + 1 < digest.POINTS and min(key)[0] < digest.NEVER:
            chosen.add(min(key)[1])
        if not chosen:
            chosen = {min(range(len(key)), key=lambda k: (-points[k], key[k]))}
        want = {digest.mixed(np.frombuffer(t[k : k + W], np.uint8).reshape(1, W).view(np.uint64))[0] for k in chosen}
        assert set(digest.features([t], ranks)[0]) == want


def test_ids_of_other_types(spark):
    rows = [("b", "one text of some length " * 9), ("a", "another text " * 12), (None, "no id"), ("c", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    ranks = digest.corpus_ranks(docs)
    got = {r["doc_id"]: r for r in digest.compare_with_edits(docs, ranks).collect()}
    own = {r["doc_id"]: r["fingerprint"] for r in digest.fingerprint_documents(docs, ranks).collect()}
    assert {k: r["fingerprint"] for k, r in got.items()} == own
    order = [None, "a", "b", "c"]
    for k, after in zip(order, order[1:] + order[:1]):
        assert got[k]["near_next"] == pytest.approx(digest.likeness(digest.parsed(own[k]), digest.parsed(own[after])))


def test_rows_without_an_id_keep_their_links(spark):
    words = [f"w{k}" for k in range(60)]
    near = " ".join(words[:59] + ["x"])
    docs = spark.createDataFrame([(None, " ".join(words)), (1, near), (2, "something else entirely here now")], "doc_id int, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.groups(docs).collect()}
    assert got == {None: 1, 1: 1, 2: 2}


def test_join_by_shuffles_alone(spark, monkeypatch):
    """Beyond the bound for broadcasts the result is the same, copies of one text and hot keys included."""
    random.seed(29)
    base = [f"w{random.randrange(10**6)}" for _ in range(80)]
    texts = [" ".join(base)] * 40
    for _ in range(30):
        w = list(base)
        w[random.randrange(80)] = f"v{random.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"u{random.randrange(10**6)}" for _ in range(40)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    first = {r["doc_id"]: r["component_id"] for r in ngram_join.groups(docs).collect()}
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.groups(docs).collect()} == first == {k: 0 if k < 70 else k for k in range(90)}


def test_short_lines_need_half_of_all_sites(spark):
    rows = [(k, f"own text of number {k}\nRead more\n联系我们了解更多信息\nOk", f"s{k}") for k in range(6)] + [(k, f"own text {k} here", f"s{k}") for k in range(6, 14)]
    rows += [(20 + k, "Ok", f"s{k}") for k in range(6, 9)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r["doc_id"]: r["line_dedup"]["text"] for r in line_dedup.without_boilerplate(docs).collect()}
    assert got[0] == rows[0][1] and got[3] == "own text of number 3\nRead more" and got[27] == ""


def test_another_seed_gives_another_mix(spark):
    docs = spark.createDataFrame([(k, "a b c " * (1 + k % 5), f"s{k % 3}") for k in range(200)], "doc_id int, text string, source string")
    taken = lambda seed: {r["doc_id"]: r["copies"] for r in mixing.mix(docs, seed=seed).collect()}
    assert taken("") == taken("") != taken("x")
