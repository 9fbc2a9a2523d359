"""Classification by ordered rules, affinities between regions, and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(text: Column, groups: list[tuple[str, list[str]]], default: str) -> Column:
    """The label of the first group one of whose words is in the text, anywhere in it."""
    hit = lambda words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    return F.coalesce(*[F.when(hit(words), label) for label, words in groups], F.lit(default))


def guarded(text: Column, lookalikes: str, forbidden: str) -> Column:
    """What in the text is forbidden: its first match once look-alikes are masked; null if there is none."""
    masked = F.regexp_replace(F.lower(text), lookalikes, " ")
    return F.nullif(F.regexp_extract(masked, forbidden, 0), F.lit(""))


def capped_tags(tags: DataFrame, caps: dict[str, int], least: float = 0.6) -> DataFrame:
    """(item, kind, value, confidence) rows confident enough, at most so many of each kind, the most confident first.

    The value ``none`` goes if its item has another of the kind.
    """
    kept = tags.filter(F.col("confidence") >= least)
    own = Window.partitionBy("item", "kind")
    other = F.max((F.col("value") != "none").cast("int")).over(own)
    kept = kept.withColumn("_other", other).filter((F.col("value") != "none") | (F.col("_other") == 0)).drop("_other")
    cap = F.element_at(F.create_map(*[F.lit(x) for k, n in caps.items() for x in (k, n)]), F.col("kind"))
    place = F.row_number().over(own.orderBy(F.desc("confidence"), "value"))
    return kept.withColumn("_n", place).filter(F.col("_n") <= cap).drop("_n")


def affinity(a: DataFrame, b: DataFrame, links: DataFrame, same: float = 0.85) -> DataFrame:
    """(a, b, affinity): the greatest product of two items' region weights and the link of the regions.

    a and b: (id, region, weight). links: (left, right, link) both ways; a region's link with itself is ``same``.
    """
    own = links.select("left").union(links.select("right")).distinct().select("left", F.col("left").alias("right"), F.lit(same).alias("link"))
    every = links.filter("left != right").unionByName(own)
    x = a.select(F.col("id").alias("a"), F.col("region").alias("left"), F.col("weight").alias("wa"))
    y = b.select(F.col("id").alias("b"), F.col("region").alias("right"), F.col("weight").alias("wb"))
    return (
        x.join(F.broadcast(every), "left").join(y, "right").groupBy("a", "b").agg(F.max(F.col("wa") * F.col("wb") * F.col("link")).alias("affinity"))
    )


def audit(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, bad, ok): for each check how many rows break it."""
    rows = [df.agg(F.count("*").alias("bad")).select(F.lit(name).alias("check"), "bad") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("ok", F.col("bad") == 0)


def ledger(sources: DataFrame, outcomes: DataFrame, key: str, cascade: list[tuple[str, Column]], default: str) -> DataFrame:
    """Every source row with one outcome: the first of the cascade that holds for it and its outcome row, if any."""
    joined = sources.join(outcomes, key, "left")
    return joined.select(key, F.coalesce(*[F.when(when, F.lit(name)) for name, when in cascade], F.lit(default)).alias("outcome"))
