"""Roll-ups, facets, unit-aware sums, weighted totals and pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_children(parents: DataFrame, children: DataFrame, on: str, child: str, aggregates: list[Column], nested: Column) -> DataFrame:
    """parents with aggregates of their children and the children nested as a sorted array ``child``; an empty one for none."""
    own = children.groupBy(on).agg(*aggregates, F.sort_array(F.collect_list(nested)).alias(child))
    out = parents.join(own, on, "left")
    return out.withColumn(child, F.coalesce(child, F.array().cast(own.schema[child].dataType)))


def change_stamp(rows: DataFrame, at: str) -> DataFrame:
    """One row: the count and the latest time, joined by a colon; it changes when rows come, go or are touched."""
    return rows.agg(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.max(at).cast("string"), F.lit(""))).alias("stamp"))


def facet_counts(rows: DataFrame, facets: dict[str, str], chosen: dict[str, list[str]]) -> DataFrame:
    """(facet, value, n): for each value how many rows would be left if it were chosen next.

    facets maps a facet to its array column. Within a facet chosen values are alternatives, across facets all must hold, and a
    facet's own choice does not narrow its counts. Chosen values without rows count 0. One pass: each row says which facets it
    meets, and a facet's values count the rows that meet all others.
    """
    meets = {
        f: F.arrays_overlap(F.col(c), F.array(*map(F.lit, chosen[f]))) if chosen.get(f) else F.lit(True) for f, c in facets.items()
    }
    every = F.array(
        *[
            F.struct(
                F.lit(f).alias("facet"),
                reduce(lambda a, b: a & b, [m for g, m in meets.items() if g != f], F.lit(True)).alias("ok"),
                F.col(c).alias("values"),
            )
            for f, c in facets.items()
        ]
    )
    counted = (
        rows.select(F.explode(every).alias("e"))
        .filter("e.ok")
        .select("e.facet", F.explode(F.array_distinct("e.values")).alias("value"))
        .groupBy("facet", "value")
        .agg(F.count("*").alias("n"))
    )
    picked = [(f, v) for f, values in chosen.items() for v in values]
    if picked:
        zero = rows.sparkSession.createDataFrame(picked, "facet string, value string").withColumn("n", F.lit(0).cast("long"))
        counted = counted.unionByName(zero).groupBy("facet", "value").agg(F.max("n").alias("n"))
    return counted


def filtered(rows: DataFrame, facets: dict[str, str], chosen: dict[str, list[str]]) -> DataFrame:
    """The rows that meet the choice of every facet; a facet without one lets all pass."""
    for facet, values in chosen.items():
        if values:
            rows = rows.filter(F.arrays_overlap(F.col(facets[facet]), F.array(*map(F.lit, values))))
    return rows


def unit_sum(lines: DataFrame, quantity: str, per: str, unit: str, order: str) -> DataFrame:
    """(name, family): base, the sum in base units (null if 0), partial if a quantity is unknown, hint (first unit), n."""
    total = F.sum(F.col(quantity) * F.col(per))
    return lines.groupBy("name", "family").agg(
        F.when(total != 0, total).alias("base"),
        F.bool_or(F.col(quantity).isNull()).alias("partial"),
        F.min_by(unit, order).alias("hint"),
        F.count("*").alias("n"),
    )


def badge(share: Column) -> Column:
    """high from 90 % on, medium from 70 % on, low below and where nothing is known."""
    return F.when(share >= 90, "high").when(share >= 70, "medium").otherwise("low")


def matched_share(rows: DataFrame, keys: list[str], weight: str, matched: Column) -> DataFrame:
    """Per key: total and matched weight, their share in percent to one decimal, and its badge."""
    out = rows.groupBy(*keys).agg(
        F.sum(weight).alias("total"), F.sum(F.when(matched, F.col(weight)).otherwise(F.lit(0))).alias("matched")
    )
    share = F.round(F.try_divide(F.col("matched") * 100, F.col("total")).cast("double"), 1)
    return out.withColumn("share", share).withColumn("badge", badge(F.col("share")))


def first_available(rows: DataFrame, key: str, kind: str, value: str, order: str, wanted: dict[str, list]) -> DataFrame:
    """Per key and output column the value of the first of its kinds that the key has; of repeated ones the last in ``order``."""
    kinds = sorted({k for ks in wanted.values() for k in ks})
    wide = rows.filter(F.col(kind).isin(kinds)).groupBy(key).pivot(kind, kinds).agg(F.max_by(value, order))
    return wide.select(key, *[F.coalesce(*[F.col(f"`{k}`") for k in ks]).alias(out) for out, ks in wanted.items()])


def first_best(rows: DataFrame, keys: list[str], score: Column, order: list[Column]) -> DataFrame:
    """The row of the greatest score of each key; of equal ones the first in ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), *order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")
