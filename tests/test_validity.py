"""Every rule of nested documents, broken once, and documents that break none."""

import pytest

from galley.operators import validity

KIND = (
    "doc string, version int, title string, yield_text string, notes array<string>, sections array<struct<id: string, heading: string, kind: string, "
    "ingredients: array<struct<id: string, text: string>>, steps: array<struct<id: string, text: string>>, "
    "actions: array<struct<id: string, label: string, sequence: int, start: string, end: string>>>>, rule string"
)


def table(ingredients=(("i1", "egg"), ("i2", "salt")), actions=(), sid="s1", heading="Dough"):
    return (sid, heading, "table", list(ingredients), [], list(actions))


def listed(ingredients=(("i1", "egg"),), sid="s1"):
    return (sid, None, "ingredients", list(ingredients), None, None)


def told(steps=(("p1", "Mix."),), sid="s2"):
    return (sid, None, "instructions", None, list(steps), None)


def doc(version, sections, title="Tart", yields="4", notes=("n",)):
    return ("d", version, title, yields, list(notes), sections, "x")


MIX = ("a1", "mix", 0, "i1", "i2")


@pytest.mark.parametrize(
    ("document", "want"),
    [
        (doc(1, [table(actions=[MIX])]), []),
        (doc(2, [listed(), told()]), []),
        (doc(2, [listed(), told()], yields=None, notes=["n"] * 100), []),
        (doc(1, [table()], title="  "), [("length of title", None, None)]),
        (doc(1, [table()], title="t" * 241), [("length of title", None, None)]),
        (doc(1, [table()], yields="y" * 161), [("length of yield", None, None)]),
        (doc(1, [table()], notes=["n"] * 31), [("number of notes", None, None)]),
        (doc(1, []), [("number of table sections", None, None)]),
        (doc(1, None), [("number of table sections", None, None)]),
        (doc(1, [table([(f"i{k}", "x")], sid=f"s{k}") for k in range(31)]), [("number of table sections", None, None)]),
        (doc(2, [listed()]), [("number of instructions sections", None, None)]),
        (doc(2, [listed(), told(), table([("i9", "x")], sid="s3")]), [("kind of section", "s3", "s3")]),
        (doc(1, [table(heading="h" * 161)]), [("length of heading", "s1", "s1")]),
        (doc(1, [table([])]), [("number of ingredients", "s1", "s1")]),
        (doc(1, [table([(f"i{k}", "x") for k in range(251)])]), [("number of ingredients", "s1", "s1")]),
        (doc(2, [listed(), told([])]), [("number of steps", "s2", "s2")]),
        (doc(1, [table([("i1", " ")])]), [("length of ingredient", "s1", "i1")]),
        (doc(2, [listed(), told([("p1", "x" * 4001)])]), [("length of step", "s2", "p1")]),
        (doc(1, [table(actions=[("a1", "", 0, "i1", "i2")])]), [("length of action", "s1", "a1")]),
        (doc(1, [table([("-", "x"), (None, "y")])]), [("id", "s1", "-"), ("id", "s1", None)]),
        (doc(1, [table([("i1", "x"), ("i1", "y"), ("i1", "z")])]), [("repeated ingredient", "s1", "i1")] * 2),
        (doc(1, [table(), table(sid="s2")]), [("repeated ingredient", "s2", "i1"), ("repeated ingredient", "s2", "i2")]),
        (doc(1, [table(), table([("j1", "x")])]), [("repeated section", "s1", "s1")]),
        (doc(2, [listed(), told([("p1", "x"), ("p1", "y")])]), [("repeated step", "s2", "p1")]),
        (doc(1, [table(actions=[MIX, MIX])]), [("repeated action", "s1", "a1")]),
        (doc(1, [table(actions=[("a1", "mix", 10_001, "i1", "i2")])]), [("sequence", "s1", "a1")]),
        (doc(1, [table(actions=[("a1", "mix", 0, "i1", "i9")])]), [("unknown line", "s1", "a1")]),
        (doc(1, [table(actions=[("a1", "mix", 0, None, "i1")])]), [("unknown line", "s1", "a1")]),
        (doc(1, [table(actions=[("a1", "mix", 0, "i2", "i1")])]), [("reversed span", "s1", "a1")]),
        (doc(1, [table(), table([("j1", "x")], [("a1", "mix", 0, "i1", "j1")], "s2")]), [("unknown line", "s2", "a1")]),
        (doc(1, [table(actions=[("a1", "mix", 0, "i2", "i2"), ("a2", "mix", 1, "i1", "i2")])]), []),
    ],
)
def test_each_rule(document, want, spark):
    got = [(r["rule"], r["section"], r["id"]) for r in validity.breaches(spark.createDataFrame([document], KIND), "doc").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_many_documents_and_none(spark):
    rows = [doc(1, [table()]), doc(1, [table()]), (None, *doc(1, [table(sid="s9", actions=[MIX, MIX])])[1:])]
    frame = spark.createDataFrame(rows, KIND)
    assert [tuple(r) for r in validity.breaches(frame, "doc").collect()] == [(None, "repeated action", "s9", "a1")]
    assert validity.breaches(frame.limit(0), "doc").count() == 0


def test_documents_are_made_once(spark):
    """Every rule reads the same documents with the same numbers, and none makes them anew."""
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    def one(x):
        made.add(1)
        return x

    docs = spark.range(20).select(F.udf(one, "long")("id").alias("doc"), F.lit(2).alias("version"), F.lit("Stew").alias("title"), F.lit("4").alias("yield_text"), F.array(F.lit("n")).alias("notes"))
    part = "struct<id: string, text: string>"
    kind = f"array<struct<id: string, heading: string, kind: string, ingredients: array<{part}>, steps: array<{part}>, actions: array<struct<id: string, label: string, sequence: int, start: string, end: string>>>>"
    got = validity.breaches(docs.withColumn("sections", F.from_json(F.lit("[]"), kind)), "doc").collect()
    assert made.value == 20
    assert sorted({r["rule"] for r in got}) == ["number of ingredients sections", "number of instructions sections"] and len(got) == 40
