"""What is wrong with nested documents, a row for each breach: lengths, counts, ids, and spans of lines.

A document's parts become rows of one table. Repeated ids are equal neighbours in the order of ids; a span finds its lines by standing
beside them, as each end of a span is a row with the id of the line that it names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.sources.tables import materialise

STABLE_ID = "^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"
# The least and the greatest length of texts, and the numbers of parts, by version of the document where they differ.
LENGTHS = {"title": (1, 240), "yield": (0, 160), "heading": (0, 160), "ingredient": (1, 500), "step": (1, 4000), "action": (1, 160)}
COUNTS = {"ingredients": (1, 250), "steps": (1, 500), "actions": (0, 500)}
SECTIONS, NOTES, SEQUENCE = (1, 30), {1: 30, 2: 100}, (0, 10_000)
#: The kinds of sections of each version, and what each holds.
KINDS = {1: ["table"], 2: ["ingredients", "instructions"]}
HOLDS = {"table": ["ingredients", "actions"], "ingredients": ["ingredients"], "instructions": ["steps"]}


def size_of(text: Column) -> Column:
    return F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\f\x0b")))


def outside(n: Column, bounds: tuple[int, int]) -> Column:
    return ~n.between(*bounds)


def breaches(documents: DataFrame, key: str) -> DataFrame:
    """key, rule, section, id: every breach of the rules of (key, version, title, yield_text, notes, sections) documents.

    sections: id, heading, kind, ingredients (id, text), steps (id, text), actions (id, label, sequence, start, end). Version 1 has
    sections of kind table, with ingredients and actions; version 2 has ingredients and instructions. Null lists are empty, null
    texts have no length, and a null id breaks the rule of ids. A document with a null key is told apart from others by nothing but
    its place; other columns are ignored. An empty table, and valid documents, give no rows.

    Rules: ``length of ...``, ``number of ...``, ``kind of section``, ``id``, ``repeated section``, ``repeated ingredient``,
    ``repeated step``, ``repeated action``, ``sequence``, ``unknown line`` (an action names a line that its section lacks) and
    ``reversed span`` (it ends before it starts).
    """
    none = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    empty = lambda c: F.coalesce(F.col(c), F.array())
    docs = documents.select(F.monotonically_increasing_id().alias("n"), F.col(key).alias("key"), "version", "title", "yield_text", "notes", "sections")
    docs = materialise(docs, "documents")  # each rule reads them, all with the same numbers

    of_kind = lambda k: F.size(F.filter(empty("sections"), lambda s: s["kind"] == k))
    whole = [("length of title", outside(size_of(F.col("title")), LENGTHS["title"])), ("length of yield", outside(size_of(F.col("yield_text")), LENGTHS["yield"]))]
    for version, kinds in KINDS.items():
        own = F.col("version") == version
        whole += [("number of notes", own & (F.size(empty("notes")) > NOTES[version]))]
        whole += [(f"number of {k} sections", own & outside(of_kind(k), SECTIONS)) for k in kinds]
    found = F.array_compact(F.array(*[F.when(bad, rule) for rule, bad in whole]))
    out = [docs.select("n", "key", F.explode(found).alias("rule"), none("section"), none("id"))]

    sections = docs.select("n", "key", "version", F.posexplode("sections").alias("s", "it"))
    it = lambda c: F.col(f"it.{c}")
    wrong_kind = reduce(lambda a, b: a & b, [~((F.col("version") == v) & it("kind").isin(kinds)) for v, kinds in KINDS.items()])
    by_section = [("kind of section", F.coalesce(wrong_kind, F.lit(True))), ("length of heading", outside(size_of(it("heading")), LENGTHS["heading"]))]
    for kind, held in HOLDS.items():
        by_section += [(f"number of {h}", (it("kind") == kind) & outside(F.size(F.coalesce(it(h), F.array())), COUNTS[h])) for h in held]
    found = F.array_compact(F.array(*[F.when(bad, rule) for rule, bad in by_section]))
    out.append(sections.select("n", "key", F.explode(found).alias("rule"), it("id").alias("section"), it("id").alias("id")))

    # One row for each part with an id, and one for each end of a span with the id of the line that it names.
    def part(kind: str, held: str, text: str) -> DataFrame:
        rows = sections.select("n", "key", "s", it("id").alias("section"), F.posexplode(f"it.{held}").alias("place", "p"))
        return rows.select("n", "key", "s", "section", "place", F.lit(kind).alias("kind"), F.col("p.id").alias("id"), F.col(f"p.{text}").alias("text"))

    parts = [part("ingredient", "ingredients", "text"), part("step", "steps", "text"), part("action", "actions", "label")]
    names = sections.select("n", "key", "s", it("id").alias("section"), F.col("s").alias("place"), F.lit("section").alias("kind"), it("id").alias("id"), none("text"))
    rows = reduce(DataFrame.unionByName, [*parts, names])
    again = F.lag("id").over(Window.partitionBy("n", "kind").orderBy("id", "s", "place"))
    lengths = [(f"length of {k}", (F.col("kind") == k) & outside(size_of(F.col("text")), LENGTHS[k])) for k in ("ingredient", "step", "action")]
    bad_id = F.coalesce(~F.rlike("id", F.lit(STABLE_ID)), F.lit(True))
    repeated = F.when(F.col("id") == again, F.concat(F.lit("repeated "), "kind"))
    found = F.array_compact(F.array(F.when(bad_id, "id"), repeated, *[F.when(bad, rule) for rule, bad in lengths]))
    out.append(rows.withColumn("found", found).select("n", "key", F.explode("found").alias("rule"), "section", "id"))

    actions = sections.select("n", "key", "s", it("id").alias("section"), F.posexplode("it.actions").alias("place", "p"))
    actions = actions.select("n", "key", "s", "section", "place", "p.*")
    out.append(actions.filter(outside(F.coalesce("sequence", F.lit(-1)), SEQUENCE)).select("n", "key", F.lit("sequence").alias("rule"), "section", "id"))
    ends = actions.select(
        "n", "key", "s", "section", F.col("place").alias("action"), "id",
        F.inline(F.array(F.struct(F.lit(0).alias("end"), F.col("start").alias("line")), F.struct(F.lit(1).alias("end"), F.col("end").alias("line")))),
    )
    lines = parts[0].select("n", "key", "s", "section", F.lit(None).cast("int").alias("action"), none("id"), F.lit(None).cast("int").alias("end"), F.col("id").alias("line"), F.col("place").alias("at"))
    beside = lines.unionByName(ends.withColumn("at", F.lit(None).cast("int")))
    beside = beside.withColumn("at", F.max("at").over(Window.partitionBy("n", "s", "line"))).filter("action is not null")
    spans = beside.groupBy("n", "s", "action").agg(
        F.first("key").alias("key"), F.first("section").alias("section"), F.first("id").alias("id"),
        F.max(F.when(F.col("end") == 0, F.col("at"))).alias("first"), F.max(F.when(F.col("end") == 1, F.col("at"))).alias("last"),
    )
    unknown = F.col("first").isNull() | F.col("last").isNull()
    rule = F.when(unknown, "unknown line").when(F.col("first") > F.col("last"), "reversed span")
    out.append(spans.withColumn("rule", rule).filter("rule is not null").select("n", "key", "rule", "section", "id"))
    return reduce(DataFrame.unionByName, out).select(F.col("key").alias(key), "rule", "section", "id")
