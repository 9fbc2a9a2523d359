"""Edits of lines, differences of texts, labels and moved lists, held against plain Python and small cases."""

import random

import pytest
from pyspark.sql import functions as F

from galley.functions import labels
from galley.operators import edits, moves
from galley.sources import report


def longest(a, b):
    """The length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_word_changes_keep_a_longest_common_part():
    draw = random.Random(7)
    for _ in range(300):
        before, after = (" ".join(draw.choice("salt oil leek egg 2½ , é".split()) for _ in range(draw.randint(0, 9))) for _ in range(2))
        parts = edits.word_changes(before, after)
        assert "".join(t for k, t in parts if k != "ins") == before and "".join(t for k, t in parts if k != "del") == after
        words = edits._WORDS.findall
        same = sum(len(words(t)) for k, t in parts if k == "same")
        spaces = sum(1 for (k, t), (m, u) in zip(parts, parts[1:]) if (k, m) == ("del", "ins") and t == u and not t.strip())
        assert same + spaces == longest(words(before), words(after))


def test_word_changes_delete_first():
    assert edits.word_changes("add salt", "add oil") == [("same", "add "), ("del", "salt"), ("ins", "oil")]
    assert edits.word_changes("", "") == [] and edits.word_changes("a", "") == [("del", "a")]


def test_edits(spark):
    lines = spark.createDataFrame(
        [("d", "step", "1", "Chop 2 leeks"), ("d", "step", "2", "For the sauce:"), ("d", "step", "3", "Stir"), ("d", "note", "0", "Import warning"), ("d", "heading", "h", "Pie")],
        "doc string, kind string, id string, text string",
    ).withColumn("protected", F.col("kind") == "note")
    asked = [
        ("d", "step", "1", "rewrite", "Chop 3 leeks", "clear", 1), ("d", "step", "2", "remove", "", "it is a section name", 2), ("d", "step", "3", "rewrite", "stir.", "tidy", 3),
        ("d", "note", "0", "remove", "", "old", 4), ("d", "step", "9", "remove", "", "unknown", 5), ("d", "heading", "h", "rewrite", " ", "empty", 6), ("d", "step", "1", "rewrite", None, "gone", 7),
        ("d", "step", "3", "remove", "", "No change needed", 8),
    ]
    got = edits.normalised(spark.createDataFrame(asked, "doc string, kind string, id string, action string, text string, reason string, seq int"), lines)
    assert {(r["kind"], r["id"], r["op"], r["after"], r["numbers_changed"]) for r in got.collect()} == {
        ("step", "1", "remove", "", False), ("step", "2", "heading", "sauce", False), ("heading", "h", "edit", "", False),
    }


def test_applied_splits_sections(spark):
    lines = spark.createDataFrame([("d", 0, "Pie", k, str(k), f"line {k}") for k in range(6)], "doc string, section int, heading string, place int, id string, text string")
    ops = spark.createDataFrame([("d", "0", "heading", "Base"), ("d", "2", "remove", ""), ("d", "3", "heading", "Top"), ("d", "5", "edit", "last")], "doc string, id string, op string, after string")
    got = [(r["part"], r["heading"], r["text"]) for r in edits.applied(lines, ops).orderBy("place").collect()]
    assert got == [(0, "Base", "line 1"), (1, "Top", "line 4"), (1, "Top", "last")]
    assert edits.applied(lines, ops.limit(0)).select("heading", "part").distinct().collect() == [("Pie", 0)]


def test_uncertain(spark):
    lines = spark.createDataFrame([(1, "2 cups Flour", "high"), (1, "Salt", "medium"), (1, None, "high"), (2, "Egg", "high")], "doc int, text string, confidence string")
    read = spark.createDataFrame([(1, "flour", "low"), (1, "burnt ?!", "low"), (1, "x", "low"), (2, "egg", "medium"), (3, "alone", "low")], "doc int, text string, confidence string")
    rows = lambda **k: {tuple(r) for r in edits.uncertain(lines, read, **k).collect()}
    assert rows() == {(1, "2 cups Flour"), (1, "burnt ?!"), (3, "alone")}
    assert rows(handwritten=True) == rows() | {(1, "Salt"), (2, "Egg")}


@pytest.mark.parametrize(
    ("said", "n", "flag"),
    [
        ("Feeds: 5 people", 5, None), ("  ", None, None), (None, None, None), ("Makes two dozen rolls", 2, None), ("a dozen eggs", 12, None), ("Yield - 3 jars", None, "volume/whole-dish yield, not servings"),
        ("6 tablespoons serving", None, "volume yield, not servings"), ("7+", 7, None), ("about 3 to 5", 3, None), ("8 (large)", 8, "leading count assumed to be servings"), ("0 portions", None, "no number"),
    ],
)
def test_servings(spark, said, n, flag):
    row = spark.createDataFrame([(said,)], "t string").select(labels.servings(F.col("t")).alias("s")).first()["s"]
    assert (row["servings"], row["flag"]) == (n, flag)


def test_labels(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    lit, no = F.lit, F.lit(False)
    assert one(*[labels.component_heading(lit(t), no) for t in ("Sauce", "To make it:", "GLAZE", "leeks, sliced", "Leeks", "")]) == (True, True, True, False, False, False)
    assert one(labels.component_heading(lit("SALT"), lit(True)), labels.line_leftover(lit("Ingredient checklist:"))) == (False, True)
    assert one(*[labels.source_brand(lit(t), lit("www.plum-pot.example/x")) for t in ("Plum Pot", "Plum Pot 2", "Pot")]) == (True, False, False)
    assert one(*[labels.leftover(lit(t), lit(None).cast("string"), lit("Rye bread")) for t in ("12 likes", "How to make rye bread.", "Share", "Knead")]) == (True, True, True, False)
    assert one(*[labels.free_tag(lit(t))["kind"] for t in ("Protein: none", "none", "equipment:wok", "cosy", "GF", "middle  eastern")]) == ("protein", "personal", "equipment", "personal", "diet", "cuisine")
    assert one(labels.model_tag(lit("cuisine"), lit("fusion"), []), labels.model_tag(lit("diet"), lit("Dairy free"), [])) == (None, "dairy-free")


def test_moves(spark):
    items = spark.createDataFrame(
        [(1, " Leek", "2", "", False, 1), (1, "LEEK  ", None, None, False, 2), (1, "Egg", None, None, True, 3), (1, None, None, None, False, 4), (2, "lék", None, None, False, 5)],
        "list int, name string, quantity string, unit string, checked boolean, at int",
    )
    assert {(r["list"], r["key"], r["name"], r["quantity"], r["unit"], r["n_sources"]) for r in moves.shopping(items, "at").collect()} == {(1, "leek", "Leek", "2", None, 2), (2, "lek", "lék", None, None, 1)}
    assert tuple(moves.shopping_counts(items).first()) == (5, 1, 1, 2, 1)
    assert tuple(moves.shopping_counts(items.limit(0)).first()) == (0, 0, 0, 0, 0)
    got = spark.range(1).select(moves.cooked_notes(F.lit(4), F.array(F.lit("would_make_again"), F.lit("too_salty")), F.lit(" fine ")).alias("n")).first()["n"]
    assert tuple(got) == (1, "Rating 4/5 · would make again, too salty · fine")


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("b|c", 2), (None, 1)], "name string, n int")
    lines = report.sections({"Names": report.table_lines(rows, ["n"])})
    report.write_report(lines, f"file://{tmp_path}/r")
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/r").collect()] == ["## Names", "| name | n |", "|---|---|", "|  | 1 |", "| b\\|c | 2 |"]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("1 1/2 cups rye flour", ("1 1/2", "cups", "rye flour", None, None)), ("250g oats", ("250", "g", "oats", None, None)), ("½ leek", ("½", None, "leek", None, None)),
        ("2 (14 oz) tins beans", ("2", None, "(14 oz) tins beans", None, None)), ("salt", (None, None, "salt", None, None)), ("3 cups", ("3", "cups", "3 cups", None, None)),
        ("1 cup / 240 ml milk", ("1", "cup", "milk", "1 cup milk", "240 ml milk")), ("1 cup / warm milk", ("1", "cup", "/ warm milk", None, None)), ("cupboard mix", (None, None, "cupboard mix", None, None)),
        ("", (None, None, "", None, None)),
    ],
)
def test_ingredient(spark, said, want):
    assert tuple(spark.createDataFrame([(said,)], "t string").select(labels.ingredient(F.col("t")).alias("i")).first()["i"]) == want


def test_clean_title(spark):
    cases = [
        ("Plum Pot: Leek Pie", "https://www.plumpot.example/x", "Leek Pie"), ("Leek Pie | Plum Pot Recipes", "plumpot.example", "Leek Pie"), ("Leek Pie - Best Of - Leek Pie | Plum Pot", "plumpot.example", "Leek Pie - Best Of"),
        ("Rye – Caraway Bread", "plumpot.example", "Rye – Caraway Bread"), ("Another try at Ann Lee's Rye Recipe", None, "Rye"), ("Leek Pie (with video)", None, "Leek Pie"), ("  Crème   Brûlée | crème", None, "Crème Brûlée"),
        ("Plum Pot", "plumpot.example", "Plum Pot"), ("", None, ""), (None, "plumpot.example", None),
    ]
    rows = spark.createDataFrame([(k, t, s) for k, (t, s, _) in enumerate(cases)], "k int, title string, site string")
    got = rows.select("k", labels.clean_title(F.col("title"), F.col("site")).alias("t")).orderBy("k").collect()
    assert [r["t"] for r in got] == [want for _, _, want in cases]
    assert spark.createDataFrame([(None,)], "t string").select(labels.ingredient(F.col("t")).alias("i")).first()["i"] is None


def test_title_notes(spark):
    owners = {"Ann": (["ann", "ann's"], "Ann Lee", None), "SV": (["sv"], None, ("equipment", "sous vide"))}
    cases = {
        "Ann's Leek Pie (from Bo)": (["Ann", "(from bo)"], "Ann Lee", [("personal", "from bo")]),
        "SV Egg, sous vide": (["SV"], None, [("equipment", "sous vide")]),
        "Rye by Chef Mo Ek": (["by Chef"], "Mo Ek", []),
        "Soup (Bo rec) in a Slow Cooker (from scratch)": (["(bo rec)"], None, [("equipment", "slow cooker"), ("personal", "from bo")]),
        "Stew (bo weekend recipe)": (["(bo weekend recipe)"], None, [("personal", "bo weekend")]),
        "Annual Pie": ([], None, []),
        None: ([], None, []),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", labels.title_notes(F.col("t"), owners).alias("n"))
    assert {r["t"]: (r["n"]["owners"], r["n"]["credit"], [tuple(x) for x in r["n"]["tags"]]) for r in rows.collect()} == cases


def test_checked_extractions(spark):
    from galley.operators import extraction

    rows = [
        ("headless", "Rye bread. Flour, water.", "Rye bread", None, ["flour"], []), ("turned", "Method\nbake\nIngredients\nrye", "Rye", None, ["rye"], ["bake"]),
        ("empty", None, None, None, None, None), ("yield", "Rye\nMakes: 2", "Rye", "2", [], []),
    ]
    docs = spark.createDataFrame(rows, "id string, source string, title string, yield_text string, ingredients array<string>, steps array<string>")
    got = {r["id"]: (r["issues"], round(r["coverage"], 2)) for r in extraction.checked(docs).collect()}
    assert got == {"headless": ([], 0.75), "turned": ([], 0.5), "empty": (["title is an address or empty"], 1.0), "yield": ([], 0.67)}
    assert {r["id"] for r in extraction.checked(docs, whole=True).collect() if "content left out" in r["issues"]} == {"headless", "turned", "yield"}
    assert extraction.checked(docs.limit(0)).count() == 0


def test_word_diff_in_small_batches(spark):
    """Texts come to a worker in the package's batches, whichever query comes first, and in any number of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = spark.range(2500).select("id", F.concat(F.lit("a "), F.col("id").cast("string")).alias("x"), F.concat(F.lit("b "), F.col("id").cast("string")).alias("y")).coalesce(1)
    got = rows.select("id", edits.word_diff(F.col("x"), F.col("y")).alias("p"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    assert all([tuple(p) for p in r["p"]] == [("del", "a"), ("ins", "b"), ("same", f" {r['id']}")] for r in got.collect())
