"""Source divergence audit: how far the sources of a language differ in their words.

Each term of a language becomes one wide row: an array with its count in every source of the language. Shares are taken over the
array, and for each source in turn a higher-order function gives the contributions of the term to the pairs with all sources,
which are summed by pair in the task that made them before anything is shuffled. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.operators.joins import hot_keys, salted_join
from galley.sources.tables import materialise
from galley.sources.workers import ship, trimmed

#: A term is a run of letters of any alphabet: of bytes that are no ASCII control character, space, digit, punctuation or symbol.
#: The table turns all others into spaces and A-Z into small letters; bytes of other alphabets stay.
LETTERS = string.ascii_lowercase.encode()
FOLDED = bytes(b if b > 0x7F else low if (low := b | 0x20) in LETTERS and b > 0x40 else 0x20 for b in range(256))
LEAST_DOCS = 3
SCALE = 1_000_000_000
#: A task gives its counts away when it holds so many terms; a longer text is split piece by piece.
TERMS_HELD, PIECE = 400_000, 1 << 20


def pieces(data: bytes) -> Iterator[bytes]:
    """``data`` cut at spaces into parts of little more than ``PIECE`` bytes."""
    start = 0
    while len(data) - start > PIECE:
        end = data.find(b" ", start + PIECE)
        if end < 0:
            break
        yield data[start:end]
        start = end
    yield data[start:]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, d): occurrences of each term in each source of a language, and the documents that hold it there.

    Each task counts its own documents first; it holds at most about ``TERMS_HELD`` terms and those of one text.
    """

    def rows(counts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (c, d) in counts.items():
            terms = pa.array(list(c), pa.binary()).cast(pa.string())
            n = len(terms)
            sums = [pa.array(list(c.values()), pa.int64()), pa.array([d[t] for t in c], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, n), pa.repeat(source, n), terms, *sums], ["lang", "source", "term", "c", "d"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = {}, 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                c, d = counts.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(c), set()
                for piece in pieces(text.translate(FOLDED)):
                    terms = piece.split()
                    c.update(terms)
                    own.update(terms)
                d.update(own)
                held += len(c) - before
                if held > TERMS_HELD:
                    yield from rows(counts)
                    counts, held = {}, 0
        yield from rows(counts)

    ship(docs.sparkSession)
    texts = docs.filter("text is not null").select(F.col("text").cast("binary").alias("text"), _name("lang"), _name("source"))
    counted = texts.mapInArrow(trimmed(scan), "lang string, source string, term string, c long, d long")
    # Tasks have summed what they hold, so a sum before the shuffle would find little; after it all of a term is in one place.
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def whole_part(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exactly, as a long; beyond what a long holds the product is a decimal."""
    up = count + 1
    wide = whole_part(up.cast("decimal(19,0)") * F.lit(SCALE), total.cast("decimal(19,0)"))
    return F.when(up < (1 << 63) // SCALE, whole_part(up * F.lit(SCALE), total)).otherwise(wide) + 1


def wide_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Wide rows (lang, term, counts, shares, share) of the kept terms, and (lang, sources, totals, total, kept) of each language.

    counts and shares follow the language's sources in code point order; share is the term's in the whole language.
    """
    entry = F.struct("source", "c")
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.collect_list(entry).alias("entries"), F.sum("d").alias("d"))
    kept = materialise(by_term.filter(F.col("d") >= least_docs).drop("d"), "terms")

    held = kept.select("lang", F.inline("entries")).groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = docs.select(_name("lang"), _name("source")).groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n"))
    groups = groups.unionByName(held).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("k"))
    listed = F.array_sort(F.collect_list(F.struct("source", "n")))
    langs = groups.groupBy("lang").agg(listed.alias("listed"), F.sum("n").alias("n")).join(sizes, "lang", "left")
    v = F.coalesce("k", F.lit(0))
    langs = langs.select(
        "lang",
        F.col("listed")["source"].alias("sources"),
        F.transform(F.col("listed")["n"], lambda n: n + v).alias("totals"),
        (F.col("n") + v).alias("total"),
        v.alias("kept"),
    )
    langs = materialise(langs, "languages")

    rows = kept.count()
    common = hot_keys(langs, "lang", rows, "kept")
    met = salted_join(kept, langs.drop("kept"), "lang", common)
    met = met.withColumn("entries", F.map_from_entries("entries"))
    count = lambda s: F.coalesce(F.element_at("entries", s), F.lit(0))
    met = met.select("lang", "term", F.transform("sources", count).alias("counts"), "totals", "total")
    whole = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    shares = F.zip_with("counts", "totals", share)
    return met.select("lang", "term", "counts", shares.alias("shares"), share(whole, F.col("total")).alias("share")), langs


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): each source of each language against the others and against the language.

    Part ``pair``: item is another source of the language, value the sum of (p - q)^2 / q over the language's terms, p the share of
    a term in the source and q in the other. Part ``term``: item is one of the ``most_terms`` terms of the source that lie furthest
    above their share in the language. A term counts if ``least_docs`` documents of the language hold it. rank goes by value,
    largest first, then by item.

    Null lang and source are ''. A document with a null or empty text, or without a term, adds no counts, but its source stands. A
    repeated row is one more document. A language without a kept term gives its pairs with value 0; one with a single source gives
    no pairs. An empty table gives no rows. Other columns are ignored. A text is read whole, of any length.
    """
    docs = docs.select("text", "lang", "source")
    terms, langs = wide_terms(docs, least_docs)
    terms = materialise(terms, "wide-terms")

    # (p - q)^2 / q is p^2 / q - 2p + q, and only its first part is no whole number; for p = q that part is p itself, so the sums of
    # the pairs of a source with itself give the rest.
    # Terms with the same counts give the same contributions.
    alike = terms.groupBy("lang", "shares").agg(F.count("*").alias("m"))
    by_source = alike.select("lang", "m", "shares", F.posexplode("shares").alias("i", "p")).withColumn("pp", F.col("p") * F.col("p"))
    made = by_source.select("lang", "m", "i", F.posexplode(F.transform("shares", lambda q: whole_part(F.col("pp"), q))).alias("j", "f"))
    summed = materialise(made.groupBy("lang", "i", "j").agg(F.sum(F.col("f") * F.col("m")).alias("f")), "pair-sums")
    own = summed.filter("i = j").select("lang", "i", F.col("f").alias("own"))
    first = langs.select("lang", "sources", F.posexplode("sources").alias("i", "source"))
    both = first.select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).filter("i != j")
    pairs = both.join(summed, ["lang", "i", "j"], "left").join(own, ["lang", "i"], "left")
    pairs = pairs.join(own.select("lang", F.col("i").alias("j"), F.col("own").alias("other")), ["lang", "j"], "left")
    pairs = pairs.withColumn("value", F.col("f") - 2 * F.col("own") + F.col("other"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    counted = terms.select("lang", "term", "share", F.posexplode(F.arrays_zip("counts", "shares")).alias("i", "own"))
    above = counted.filter((F.col("own.counts") > 0) & (F.col("own.shares") > F.col("share")))
    over = F.col("own.shares") - F.col("share")
    marks = above.select("lang", "i", F.col("term").alias("item"), whole_part(over * over, F.col("share")).alias("value"))
    marks = ranked(marks, ["lang", "i"])
    names = first.select("lang", "i", "source")
    marks = marks.filter(F.col("rank") <= most_terms).join(names, ["lang", "i"])
    marks = marks.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return ranked(pairs, ["lang", "source", "part"]).unionByName(marks)


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with their rank in ``by``: value descending, item ascending."""
    order = Window.partitionBy(*by).orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))
