"""What share of each recipe's needs is not at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def staple_keys(keys: DataFrame, staples: DataFrame, always: tuple[str, ...] = ("water", "ice")) -> DataFrame:
    """The distinct keys that are staples: empty, always at hand, equal to a staple, or holding it with all its words.

    A staple is met through its first word, so keys and staples join by words and not each with each. Only a hash of the key goes
    with each of its words.
    """
    words = lambda c: F.split(F.col(c), r"\s+")
    distinct = keys.select("key").distinct()
    listed = staples.select(F.lower("name").alias("staple")).distinct().withColumn("word", F.element_at(words("staple"), 1))
    by_word = distinct.select(F.xxhash64("key").alias("hash"), F.explode(F.array_distinct(words("key"))).alias("word"))
    met = by_word.join(listed, "word").select(F.col("hash").alias("met"), "staple")
    whole = F.contains("key", "staple") & (F.size(F.array_except(words("staple"), words("key"))) == 0)
    held = distinct.join(met, (F.xxhash64("key") == F.col("met")) & whole, "left_semi")
    plain = distinct.filter((F.col("key") == "") | F.col("key").isin(*always))
    return held.union(plain).distinct()


def coverage(lines: DataFrame, staples: DataFrame, limit: int | None = None) -> DataFrame:
    """id, title, to_buy_count, percent_to_buy of (id, title, key) lines, least to buy first."""
    marked = lines.join(staple_keys(lines, staples).withColumn("have", F.lit(True)), "key", "left")
    return missing_share(marked.withColumn("have", F.coalesce("have", F.lit(False))), limit)


def missing_share(marked: DataFrame, limit: int | None = None) -> DataFrame:
    """id, title, to_buy_count, percent_to_buy of (id, title, key, have) lines; repeated keys of an id count once."""
    once = marked.groupBy("id", "title", "key").agg(F.bool_and("have").alias("have"))
    out = once.groupBy("id", "title").agg(F.count_if(~F.col("have")).alias("to_buy_count"), F.count("*").alias("keys"))
    percent = F.bround(F.col("to_buy_count") * 100 / F.greatest("keys", F.lit(1))).cast("int")
    out = out.select("id", "title", "to_buy_count", percent.alias("percent_to_buy"))
    return out if limit is None else out.orderBy("percent_to_buy", "to_buy_count", "title", "id").limit(limit)
