"""Mixing sources to target weights by systematic sampling.

Each document of a source has the same expected number of copies, its source's target over its source's size. Those are
prefix-summed within the source, one random offset is added, and a document is emitted once per integer boundary that its
stretch crosses. Documents of a source are taken in order of size: the words taken then differ from the target by less than
about twice its largest document, as what a boundary adds too soon it lacks among documents of nearly the same size.

The prefix sum needs no group in one task. (doc_id, source, size) rows are range-partitioned by source, size and doc_id, so a
source that holds a third of all rows covers a third of the partitions; each partition counts its rows by source, and a
row's place in its source is its place in the partition plus the counts of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.operators.joins import hot_keys, salted_join
from galley.sources.tables import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
LIMIT = 3
#: What stands for a null source, so that sources can be compared and joined.
NO_SOURCE = "\0null"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT, seed: str = "") -> DataFrame:
    """source, source_size, target, offset, k (rows) for (source, size) rows; offset in [0, 1) depends on seed and source alone.

    The excess of a source above ``limit`` times its size goes to the others by weight, until none is above. That ends with
    every source at the lower of its limit and its weight times one level, so the sources are put in the order in which they
    meet their limit as the level rises, and the level is found from running sums. The table has a row per source.
    """
    one = F.lit(0)
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("k"))
    named = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(named) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    w = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(limit))
    rising = Window.partitionBy(one).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(one)
    w = w.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    )
    full = F.col("cap") < F.col("weight") * F.col("level")
    w = w.withColumn("found", F.max(F.when(~full, F.col("level"))).over(every))
    digits = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit(NO_SOURCE))))
    return w.select(
        "source",
        "source_size",
        F.least("cap", F.col("weight") * F.coalesce("found", F.lit(0.0))).alias("target"),
        (F.conv(F.substring(digits, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)).alias("offset"),
        "k",
    )


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table) of (name, size, doc_id, ...) with place, 1, 2, ... within the name by size and doc_id.

    Rows that agree in all three are interchangeable: they take successive places.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, F.col("name"), F.col("size"), F.col("doc_id"))
    kept = materialise(ranged.withColumn("part", F.spark_partition_id()), "placed")
    own = Window.partitionBy("part", "name").orderBy("size", "doc_id")
    counts = kept.groupBy("part", "name").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "name", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    numbered = kept.withColumn("place", F.row_number().over(own)).join(starts, ["part", "name"])
    return numbered.withColumn("place", F.col("place") + F.col("start")).drop("part", "start")


def stretches(docs: DataFrame, weights: tuple, limit: int, seed: str) -> DataFrame:
    """doc_id, source, size, source_size, target, offset, rate, place of each document. The texts are read once, for their sizes."""
    name = F.coalesce(F.col("source"), F.lit(NO_SOURCE)).alias("name")
    sizes = materialise(docs.select("doc_id", "source", name, n_words(F.col("text")).alias("size")), "sizes")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    found = source_targets(sizes, weights, limit, seed).withColumn("rate", rate)
    targets = materialise(found.withColumn("name", F.coalesce(F.col("source"), F.lit(NO_SOURCE))).drop("source"), "targets")
    return salted_join(placed(sizes), targets.drop("k"), "name", hot_keys(targets, "name", sizes.count())).drop("name")


def copies(place: Column, limit: int) -> Column:
    """How many integer boundaries the stretch of the document at a place crosses."""
    at = lambda p: F.floor(F.col("offset") + F.col("rate") * p)
    return F.least(at(place) - at(place - 1), F.lit(limit)).cast("long")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT, seed: str = "") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document; one row per input row.

    A null source is a source of its own, last in order; a null text has size 0. Documents of size 0 take part and take no
    words. A repeated row is a document of its own. An empty table gives no rows. Other columns are ignored. Another ``seed``
    gives other offsets; the same one gives the same mix again.
    """
    taken = stretches(docs, weights, limit, seed).withColumn("copies", copies(F.col("place"), limit))
    return taken.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT, seed: str = "") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with its columns unchanged.

    Places are found from ids and sizes alone. Rows alike in doc_id, source and size have successive places, so one row for each
    such key, with its first place, goes back to the texts, which are shuffled once, by that key.
    """
    key = lambda: [F.xxhash64(F.lit(k), "doc_id", "source", "size").alias(f"key{k}") for k in (0, 1)]
    at = stretches(docs, weights, limit, seed)
    starts = at.select(*key(), "place", "rate", "offset").groupBy("key0", "key1").agg(
        F.min("place").alias("start"), F.first("rate").alias("rate"), F.first("offset").alias("offset")
    )
    held = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"), "doc_id", "source", n_words(F.col("text")).alias("size")
    ).select("doc", *key())
    number = F.row_number().over(Window.partitionBy("key0", "key1").orderBy(F.xxhash64("doc.text")))
    joined = held.withColumn("n", number).join(starts, ["key0", "key1"])
    n = copies(F.col("start") + F.col("n") - 1, limit).cast("int")
    return joined.select("doc", F.explode(F.array_repeat(F.lit(0), n))).select("doc.*")
