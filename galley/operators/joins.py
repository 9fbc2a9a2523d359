"""Joins whose hot keys are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of all rows, so there are fewer than 1 / HOT hot keys, whatever the input.
HOT = 1 / 1024
SALTS = 128


def hot_keys(counted: DataFrame, key: str | list[str], total: int, count: str = "k") -> DataFrame:
    """The keys of (key, count) rows that hold more than ``HOT`` of ``total`` rows."""
    return counted.filter(F.col(count) > HOT * total).select(*([key] if isinstance(key, str) else key))


def salted_join(many: DataFrame, few: DataFrame, key: str | list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined with ``few`` by ``key``: rows of hot keys are dealt by the task that reads them to up to ``SALTS`` tasks.

    ``few`` is repeated once for each salt, for hot keys alone. ``hot`` (fewer than 1 / HOT rows, from ``hot_keys``) is
    broadcast. how: inner or left. Rows of equal content may have different salts, so repeated rows are spread as well.
    """
    keys = [key] if isinstance(key, str) else key
    salts = max(1, min(SALTS, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    flag = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = many.join(flag, keys, "left").withColumn("_salt", salt).drop("_hot")
    copies = few.join(flag, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
