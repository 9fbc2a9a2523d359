"""Lexical, semantic and fused search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.text import alias_keys, ratio, tokens, without_labels
from galley.operators.ranking import fuse
from galley.sources.tables import materialise

#: Weights of the fields of a document. Fixed values.
FIELDS = {"title": 5.0, "tags": 3.0, "ingredients": 2.0, "source": 1.0}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic(vectors: DataFrame, query: list[float], limit: int = 40) -> DataFrame:
    """(id, score, rank) of the ``limit`` vectors most alike the query, by cosine to four decimals; ties by id, descending.

    The query is a literal, so it is one scan with a bounded top-k for each task.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("id", F.round(cosine(F.col("vector"), q), 4).alias("score"))
    top = scored.orderBy(F.desc("score"), F.desc("id")).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("id"))) - 1)


def postings(docs: DataFrame, fields: dict[str, float] = FIELDS) -> DataFrame:
    """(id, word, weight): the words of each document with the weight of the best field they are in."""

    def weighted(weight: float) -> Callable[[Column], Column]:
        return lambda w: F.struct(w.alias("word"), F.lit(weight).alias("weight"))

    parts = [F.transform(tokens(F.coalesce(F.col(f), F.lit(""))), weighted(x)) for f, x in fields.items()]
    return docs.select("id", F.explode(F.concat(*parts)).alias("p")).groupBy("id", "p.word").agg(F.max("p.weight").alias("weight"))


def term_scores(words: DataFrame, terms: list[str], fuzzy: bool = True) -> DataFrame:
    """(word, term, match): 1 for equal, 0.8 for a prefix of three letters or more, 0.6 times the ratio of near ones.

    Near: four letters or more in the term, lengths at most two apart, a ratio of 0.8 or more. Each distinct word is compared
    once, however many documents have it.
    """
    pairs = words.select("word").distinct().withColumn("term", F.explode(F.array(*map(F.lit, terms))))
    near = (F.length("term") >= 4) & (F.abs(F.length("word") - F.length("term")) <= 2)
    exact = F.when(F.col("word") == F.col("term"), 1.0).when(
        F.startswith("word", "term") & (F.length("term") >= 3), 0.8
    )
    scored = pairs.withColumn("match", exact)
    if fuzzy:
        alike = scored.filter(F.col("match").isNull() & near).withColumn("r", ratio("term", "word")).filter("r >= 0.8")
        scored = scored.filter("match is not null").unionByName(alike.select("word", "term", (F.col("r") * 0.6).alias("match")))
    return scored.filter("match is not null")


def lexical(docs: DataFrame, terms: list[str], limit: int | None = 40, fuzzy: bool = True, fields: dict[str, float] = FIELDS) -> DataFrame:
    """(id, score): the sum over terms of each one's best field; a document without a match for some term is not found."""
    posted = postings(docs, fields)
    matched = posted.join(term_scores(posted, sorted(set(terms)), fuzzy), "word")
    best = matched.groupBy("id", "term").agg(F.max(F.col("match") * F.col("weight")).alias("best"))
    times = F.element_at(F.create_map(*[F.lit(x) for t in sorted(set(terms)) for x in (t, float(terms.count(t)))]), F.col("term"))
    found = best.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("best") * times).alias("score"))
    found = found.filter(F.col("n") == len(set(terms))).select("id", F.round("score", 3).alias("score"))
    return found if limit is None else found.orderBy(F.desc("score"), "id").limit(limit)


def ranked(found: DataFrame) -> DataFrame:
    """(id, score, rank) of a bounded list."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


def hybrid(lexical_list: DataFrame, semantic_list: DataFrame, limit: int = 10, least: float = 0.35) -> DataFrame:
    """Both lists fused; where there are lexical hits, semantic ones need a score of ``least``. Both lists are bounded."""
    any_hit = lexical_list.agg((F.count("*") > 0).alias("any"))
    kept = semantic_list.crossJoin(F.broadcast(any_hit)).filter((F.col("score") >= least) | ~F.col("any")).drop("any")
    fused = fuse([ranked(lexical_list), kept.select("id", "rank")])
    return fused.orderBy(F.desc("score"), "list", "rank").limit(limit)


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents with any of the terms: Okapi BM25 over (id, text).

    One pass counts words and matches of each document without spreading its words out, and writes the counts, which the sums
    over all documents and the scores then read.
    """
    words = tokens(F.coalesce(F.col("text"), F.lit("")))
    each = materialise(docs.select("id", words.alias("w")).select(
        "id",
        F.size("w").alias("size"),
        *[(F.size("w") - F.size(F.array_remove("w", t))).alias(f"tf{k}") for k, t in enumerate(terms)],
    ), "terms")
    total = each.agg(
        F.count("*").alias("docs"),
        F.avg("size").alias("mean"),
        *[F.sum((F.col(f"tf{k}") > 0).cast("int")).alias(f"df{k}") for k in range(len(terms))],
    )
    tf = lambda k: F.col(f"tf{k}")
    idf = lambda k: F.ln(1 + (F.col("docs") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
    score = sum(
        (idf(k) * tf(k) * (k1 + 1) / (tf(k) + k1 * (1 - b + b * F.col("size") / F.col("mean"))) for k in range(len(terms))), F.lit(0.0)
    )
    found = each.filter(F.greatest(*[tf(k) for k in range(len(terms))], F.lit(0)) > 0)
    return found.crossJoin(F.broadcast(total)).select("id", score.alias("score"))


# Words that make a food special, for infants or cooked, and categories of what is eaten out.
SPECIAL = (
    "nonfat free low reduced substitute imitation light lite diet dietetic sweetened unsweetened fortified dehydrated frozen canned cooked dried dry "
    "smoked cured breaded fried mix prepared"
).split()
COOKED = "cooked roasted boiled baked fried grilled canned dried toasted".split()
INFANT = ["babyfood", "infant", "formula"]
EATEN_OUT = ["Restaurant Foods", "Fast Foods", "Baby Foods"]


def all_then_any(docs: DataFrame, terms: list[str], fields: dict[str, float], title: str, pool: int = 200, limit: int = 10) -> DataFrame:
    """(id, tier, score, place): documents with all terms, then those with any, ``limit`` in all.

    Within a tier the ``pool`` best by weighted BM25 (less is better) are scored again: long titles, special forms, food for infants
    or from restaurants and brands in capitals lose, a first part of the title that holds a term, raw forms and foods with portions
    gain. docs: id, the fields, the title, and, if there are any, category and with_portions.
    """
    words = {f: tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    tf = lambda t: reduce(lambda a, b: a + b, [F.lit(w) * (F.size(words[f]) - F.size(F.array_remove(words[f], t))) for f, w in fields.items()])
    size = reduce(lambda a, b: a + b, [F.size(w) for w in words.values()])
    given = docs.columns
    category = F.col("category") if "category" in given else F.lit(None).cast("string")
    portions = F.col("with_portions") if "with_portions" in given else F.lit(False)
    kept = [F.col(title).alias("title"), category.alias("category"), portions.alias("with_portions"), size.alias("size")]
    each = docs.select("id", *kept, *[tf(t).cast("double").alias(f"tf{k}") for k, t in enumerate(terms)])
    each = materialise(each, "terms")
    n = range(len(terms))
    total = each.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in n])
    idf = lambda k: F.greatest(F.ln((F.col("docs") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)), F.lit(1e-6))
    part = lambda k: idf(k) * F.col(f"tf{k}") * 2.2 / (F.col(f"tf{k}") + 1.2 * (0.25 + 0.75 * F.col("size") / F.col("mean")))
    found = reduce(lambda a, b: a + b, [(F.col(f"tf{k}") > 0).cast("int") for k in n])
    scored = each.crossJoin(F.broadcast(total)).select(  # one row of sums
        "id", "title", "category", "with_portions", F.round(-reduce(lambda a, b: a + b, [part(k) for k in n]), 9).alias("bm"), found.alias("found")
    )
    low = F.lower("title")
    first = F.regexp_extract(low, "^[^,(]*", 0)
    said = tokens(F.col("title"))
    head = reduce(lambda a, b: a | b, [F.contains(first, F.lit(t)) | F.startswith(first, F.lit(t[:4])) for t in terms])
    special = F.size(F.array_intersect(said, F.array(*[F.lit(w) for w in SPECIAL if w not in terms])))
    again = (
        F.col("bm") + 0.04 * F.length("title") + 1.5 * special + F.when(head, -1.5).otherwise(0.0)
        + F.when(F.array_contains(said, "raw") & F.lit(not set(terms) & set(COOKED)), -1.0).otherwise(0.0)
        + F.when(F.rlike("title", F.lit(r"\b[A-Z][A-Z'&]{2,}\b")), 2.0).otherwise(0.0)
        + F.when(F.arrays_overlap(said, F.array(*map(F.lit, INFANT))), 5.0).otherwise(0.0)
        + F.when(F.col("category").isin(EATEN_OUT), 4.0).otherwise(0.0) - F.when(F.col("with_portions"), 0.3).otherwise(0.0)
    )
    tiers = [scored.filter(F.col("found") == len(terms)), scored.filter((F.col("found") > 0) & (F.col("found") < len(terms)))]
    best = reduce(
        DataFrame.unionByName,
        [t.orderBy("bm", "id").limit(pool).select("id", F.lit(k).alias("tier"), F.round(again, 6).alias("score")) for k, t in enumerate(tiers)],
    )
    order = Window.orderBy("tier", "score", "id")  # at most two pools of rows
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def alias_lookup(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (with a column name) with food and tier: what a curated (name, food) list knows each name as, or null.

    A name is looked up as it is, then by its words in any order, then without words that change nothing, each without labels such as
    gluten-free. Of several foods with one key the smallest counts. Each distinct name is looked up once, however many rows have it;
    null and empty names find nothing, other columns stay.
    """
    known = aliases.select("food", alias_keys(F.col("name")).alias("k"))
    listed = F.array(F.struct(F.lit(1).alias("n"), F.col("k.exact").alias("key")), F.struct(F.lit(2).alias("n"), F.col("k.sorted").alias("key")))
    known = known.select("food", F.inline(listed)).groupBy("n", "key").agg(F.min("food").alias("food"))
    plain = without_labels(F.col("name"))
    asked = names.select("name").distinct().withColumn("k", alias_keys(F.when(plain != "", plain).otherwise(F.col("name"))))
    tiers = F.array(
        F.struct(F.lit("exact").alias("tier"), F.lit(1).alias("n"), F.col("k.exact").alias("key")),
        F.struct(F.lit("any order").alias("tier"), F.lit(2).alias("n"), F.col("k.sorted").alias("key")),
        F.struct(F.lit("plain").alias("tier"), F.lit(2).alias("n"), F.col("k.plain").alias("key")),
    )
    asked = asked.select("name", F.posexplode(tiers).alias("place", "t")).select("name", "place", "t.*").filter("key <> ''")
    best = asked.join(known, ["n", "key"]).groupBy("name").agg(F.min(F.struct("place", "food", "tier")).alias("best"))
    return names.join(best, "name", "left").select(*names.columns, "best.food", "best.tier")
