"""Top-k, caps, quotas, tiers, numbering and fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.sources.tables import materialise


def capped_top(rows: DataFrame, group: str, order: list[Column], cap: Column | int, limit: int | None = None) -> DataFrame:
    """At most ``cap`` rows of each group in ``order``, and of those the first ``limit``. The order must have no ties."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    out = rows.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")
    return out if limit is None else out.orderBy(*order).limit(limit)


def round_robin(rows: DataFrame, group: str, order: list[Column], per_group: int) -> DataFrame:
    """rows with turn, 1 for the first of each group, 2 for the second, up to ``per_group``; sort by turn and group to read."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(
        F.col("turn") <= per_group
    )


def hash_quota(rows: DataFrame, group: str, key: str, quota: int) -> DataFrame:
    """The ``quota`` rows of each group whose key has the least sha256: a sample that stays the same as others come."""
    return capped_top(rows, group, [F.sha2(F.col(key).cast("string"), 256), F.col(key)], quota)


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row in ``order`` of each key."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n")


def keep_last_in_first_place(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The last row of each key by ``place``, put at the place of its first."""
    w = Window.partitionBy(*keys)
    last = F.row_number().over(w.orderBy(F.col(place).desc()))
    return rows.withColumns({"_n": last, "_at": F.min(place).over(w)}).filter("_n = 1").withColumn(place, F.col("_at")).drop("_n", "_at")


def numbered_slugs(rows: DataFrame, base: str, order: str) -> DataFrame:
    """rows with slug: the base for the first of each base in ``order``, base-2 for the second, and so on; no slug twice.

    A base may itself end like a numbered one (pie-2). Of two rows that come to the same slug the earlier keeps it, and the other
    and those behind it with its base move on by one; that is repeated until all differ, at least one row settling each time.
    """
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    named = lambda df: df.withColumn("slug", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws("-", base, F.col("_n").cast("string"))))
    out = materialise(named(rows.withColumn("_n", n)), "slugs")
    while True:
        twice = out.groupBy("slug").agg(F.min(order).alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k")
        lost = out.join(twice, "slug").filter(F.col(order) > F.col("first")).groupBy(base).agg(F.sort_array(F.collect_list("_n")).alias("lost"))
        lost = materialise(lost, "slugs-lost")
        if lost.isEmpty():
            return out.drop("_n")
        moved = F.coalesce(F.size(F.filter("lost", lambda k: k <= F.col("_n"))), F.lit(0))
        out = materialise(named(out.join(lost, base, "left").withColumn("_n", F.col("_n") + moved).drop("lost", "slug")), "slugs")


def islands(rows: DataFrame, keys: list[str], order: list[Column], is_head: Column) -> DataFrame:
    """rows with island, how many heads there are up to the row: a head opens the group of the rows behind it."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(F.when(is_head, 1).otherwise(0)).over(running))


def near_best(rows: DataFrame, keys: list[str], score: str, share: float = 0.15) -> DataFrame:
    """The rows whose score is ``share`` of the best of their key or more."""
    best = F.max(score).over(Window.partitionBy(*keys))
    return rows.withColumn("_best", best).filter(F.col(score) >= share * F.col("_best")).drop("_best")


def fuse(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """(id, score, list, rank): reciprocal rank fusion of (id, rank) lists with ranks from 0.

    score sums 1 / (k + rank + 1). list and rank are those of an id's first appearance, which break ties.
    """
    every = reduce(
        DataFrame.unionByName, (r.select("id", "rank").withColumn("list", F.lit(n)) for n, r in enumerate(rankings))
    )
    return every.groupBy("id").agg(
        F.sum(F.lit(1.0) / (F.lit(k + 1) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first")
    ).select("id", "score", F.col("first.list").alias("list"), F.col("first.rank").alias("rank"))


def first_tier(rows: DataFrame, key: str, tiers: list[Column], order: list[Column]) -> DataFrame:
    """rows in the first tier that holds for them, once for each key, with tier from 0; rows of no tier go."""
    tier = F.coalesce(*[F.when(t, F.lit(n)) for n, t in enumerate(tiers)])
    return keep_first(rows.withColumn("tier", tier).filter("tier is not null"), [key], [F.col("tier"), *order])


def claimed(jobs: DataFrame, queue: str, order: list[Column]) -> DataFrame:
    """The oldest job of each queue with status ``queued``, as a worker claims it."""
    return keep_first(jobs.filter("status = 'queued'"), [queue], order)


def overfetched(rows: DataFrame, order: list[Column], keep: Column, limit: int, times: int = 3, least: int = 30) -> DataFrame:
    """The first ``limit`` of those that pass ``keep`` among the first ``times`` as many (``least`` or more) in ``order``."""
    return rows.orderBy(*order).limit(max(limit * times, least)).filter(keep).orderBy(*order).limit(limit)


def in_listed_order(value: Column, listed: list[str]) -> Column:
    """A sort key: the place in a list of values; what is not in it comes last."""
    place = F.array_position(F.array(*map(F.lit, listed)), value)
    return F.when(place > 0, place.cast("int")).otherwise(len(listed) + 1)


def title_order(title: Column) -> Column:
    """A sort key for titles: without punctuation in front, regardless of case and accents."""
    return F.collate(F.regexp_replace(title, r"^[^\p{L}\p{N}]+", ""), "UNICODE_CI_AI")


def first_tiers(rows: DataFrame, key: list[str], first: Column, order: list[Column], cap: int) -> DataFrame:
    """Per key the rows for which ``first`` holds, then the others, each in ``order``, at most ``cap``, with place."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(first.desc(), *order))
    return rows.withColumn("place", place).filter(F.col("place") <= cap)


def line_windows(lines: DataFrame, keys: list[str], place: str, text: str) -> DataFrame:
    """keys, place, window: each line, and each line with the next one."""
    after = F.lead(text).over(Window.partitionBy(*keys).orderBy(place))
    pairs = lines.withColumn("_next", after)
    return pairs.select(*keys, place, F.explode(F.array_compact(F.array(F.col(text), F.when(F.col("_next").isNotNull(), F.concat_ws(" ", text, "_next"))))).alias("window"))
