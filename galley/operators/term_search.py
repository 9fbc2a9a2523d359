"""Search as you type: an inverted index by field that serves exact terms, beginnings of terms and misspelt terms at once.

Terms within a few edits of one another share what is left of their first letters when as many of them are deleted on both sides.
So misspelt terms meet by an equality join on these rests, and only terms that meet are compared letter by letter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.operators.joins import hot_keys, salted_join
from galley.sources.tables import materialise

# What a field counts for, what an exact term is worth against a beginning and a misspelt one, and the ranking's constants.
BOOSTS = {"title": 6.0, "tags": 3.0, "ingredients": 2.0, "source": 1.5, "notes": 1.0}
PREFIX_WEIGHT, FUZZY_WEIGHT, PREFIX_FROM = 0.7, 0.3, 2
K, B, DELTA = 1.2, 0.7, 0.5
#: Results below this share of the best one's score are dropped.
FLOOR = 0.15
#: Letters of a term that are thinned out. With more the rests are rarer, but there are more of them.
HEAD = 8


def edits_allowed(term: Column) -> Column:
    """How far a found term may be from a searched one: two edits from eight letters, one from five."""
    return F.when(F.length(term) >= 8, 2).when(F.length(term) >= 5, 1).otherwise(0)


def rests(term: Column, edits: int) -> Column:
    """What is left of the first ``HEAD`` letters without up to ``edits`` of them.

    Of two terms k edits apart, the first letters of either hold all but k in common, in order: a letter is lost by an edit at it, or
    because an insertion before it has moved its counterpart out, which is an edit as well. Deleting up to k letters from both so
    gives a common rest, however long the terms are.
    """
    without = lambda v: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), lambda i: F.concat(F.left(v, i - 1), F.substring(v, i + 1, F.lit(HEAD)))
    )
    every = [F.array(F.left(term, F.lit(HEAD)))]
    for _ in range(edits):
        every.append(F.array_distinct(F.flatten(F.transform(every[-1], without))))
    return F.array_distinct(F.concat(*every))


def near_terms(searched: DataFrame, terms: DataFrame, allowed: Column | None = None, most: int = 2) -> DataFrame:
    """(searched, term, edits): the pairs of both tables' distinct terms that lie within the allowed number of edits, at least one.

    allowed is a Column of ``searched`` and at most ``most``; by default it goes by length. Null terms meet nothing, empty ones
    whatever is as short as the edits allowed.
    """
    allowed = edits_allowed(F.col("searched")) if allowed is None else allowed
    asked = searched.select("searched").distinct().withColumn("k", allowed).filter("k > 0")
    short = asked.agg(F.min(F.length("searched") - F.col("k"))).first()[0]
    if short is None:
        return asked.select("searched", F.col("searched").alias("term"), F.col("k").alias("edits")).limit(0)
    by_edits = reduce(lambda a, b: a.otherwise(b), [F.when(F.col("k") <= k, rests(F.col("searched"), k)) if k < most else rests(F.col("searched"), most) for k in range(1, most + 1)])
    asked = asked.select("searched", "k", F.explode(by_edits).alias("rest"))
    known = terms.select("term").distinct().filter(F.length("term") >= short)
    known = known.select("term", F.explode(rests(F.col("term"), most)).alias("rest"))
    close = F.abs(F.length("searched") - F.length("term")) <= F.col("k")
    met = asked.join(known, "rest").filter(close & (F.col("searched") != F.col("term"))).select("searched", "term", "k").distinct()
    got = met.withColumn("edits", F.levenshtein("searched", "term"))
    return got.filter(F.col("edits") <= F.col("k")).select("searched", "term", "edits")


def terms_of(text: Column) -> Column:
    """The terms of a text: what stands between spaces and punctuation, in small letters and without accents."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\n\r\p{Z}\p{P}]+")
    return F.filter(F.transform(parts, lambda t: folded_plain(t)), lambda t: t != "")


def folded_plain(term: Column) -> Column:
    """Lower case without accents, for the letters that Unicode composes; Spark's own functions only."""
    return F.lower(F.translate(term, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"))


def index(docs: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings (term, field, id, tf, size) and the means (field, mean, docs) of an (id, fields) table, both written.

    size is the number of different terms in the field, whose mean is taken over all documents, those without the field too.
    """
    each = [
        F.struct(F.lit(f).alias("field"), terms_of(F.col(f)).alias("terms"))
        for f in fields
    ]
    rows = docs.select("id", F.inline(F.array(*each))).withColumn("size", F.size(F.array_distinct("terms")))
    sizes = rows.groupBy("field").agg((F.sum("size") / F.count("*")).alias("mean"), F.count("*").alias("docs"))
    posted = rows.select("id", "field", "size", F.explode("terms").alias("term")).groupBy("term", "field", "id").agg(F.count("*").alias("tf"), F.first("size").alias("size"))
    return materialise(posted, "postings"), materialise(sizes, "field-sizes")


def expanded(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """(searched, term, weight): what each searched term stands for. A term that is found in two ways counts once: exactly, as
    a longer form, or as a misspelt one, in this order."""
    searched = asked.select(F.col("term").alias("searched")).distinct()
    known = terms.select("term").distinct()
    exact = searched.join(known, F.col("searched") == F.col("term")).select("searched", "term", F.lit(1.0).alias("weight"))
    starts = F.transform(F.sequence(F.lit(PREFIX_FROM), F.length("term") - 1), lambda n: F.left("term", n))
    heads = known.filter(F.length("term") > PREFIX_FROM).select("term", F.explode(starts).alias("searched"))
    longer = F.length("term") / (F.length("term") + 0.3 * (F.length("term") - F.length("searched")))
    longer = heads.join(searched, "searched").select("searched", "term", (PREFIX_WEIGHT * longer).alias("weight"))
    near = near_terms(searched, known).join(longer.select("searched", "term"), ["searched", "term"], "left_anti")
    near = near.select("searched", "term", (FUZZY_WEIGHT * F.length("term") / (F.length("term") + F.col("edits"))).alias("weight"))
    return exact.unionByName(longer).unionByName(near)


def search(docs: DataFrame, queries: DataFrame, boosts: dict[str, float] = BOOSTS, floor: float = FLOOR) -> DataFrame:
    """(query, id, score, rank) of every query (query, text) over documents (id and the fields of ``boosts``).

    Documents with all terms of a query, in any form, or, if none has all, those with any. A term scores in each field by its
    frequency, the field's length and how many documents have it there; the sum counts once for each different term that is found.
    What scores less than ``floor`` of the best is dropped; ties go by id.

    A null text has no terms, a query without terms finds nothing. A repeated id is one document whose fields are added. An empty
    table gives no rows. Each query's result is ranked by itself: the results of one query meet in one task.
    """
    posted, sizes = index(docs, list(boosts))
    asked = queries.select("query", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    asked = materialise(asked, "searched-terms")
    forms = materialise(expanded(asked, posted), "term-forms")
    held = posted.join(F.broadcast(sizes), "field")  # a row for each field of boosts
    df = posted.groupBy("term", "field").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K + 1) / (F.col("tf") + K * (1 - B + B * F.col("size") / F.col("mean")))
    boost = F.element_at(F.create_map(*[F.lit(x) for f, w in boosts.items() for x in (f, w)]), F.col("field"))
    wanted = df.join(forms, "term").select("term", "field", "searched", "weight", "df")
    common = hot_keys(df.groupBy("term").agg(F.sum("df").alias("k")), "term", posted.count())
    met = salted_join(held, wanted.withColumnRenamed("field", "in_field"), "term", common).filter(F.col("field") == F.col("in_field"))
    of_term = met.select("id", "searched", (F.col("weight") * boost * idf * (DELTA + tf)).alias("s")).groupBy("searched", "id").agg(F.sum("s").alias("s"))
    of_term = of_term.join(asked.withColumnRenamed("term", "searched"), "searched")
    found = of_term.groupBy("query", "id").agg(F.sum(F.col("s") * F.col("times")).alias("s"), F.count("*").alias("n"))
    whole = asked.groupBy("query").agg(F.count("*").alias("terms"))
    found = materialise(found.join(whole, "query"), "found-documents")
    best = found.groupBy("query").agg(F.max(F.col("n") == F.col("terms")).alias("any_whole"))
    kept = found.join(best, "query").filter(~F.col("any_whole") | (F.col("n") == F.col("terms")))
    kept = kept.select("query", "id", F.round(F.col("s") * F.col("n"), 6).alias("score"))
    top = kept.groupBy("query").agg(F.max("score").alias("top"))
    kept = kept.join(top, "query").filter(F.col("score") >= floor * F.col("top"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return kept.select("query", "id", "score", F.row_number().over(order).alias("rank"))
