"""Line dedup by distinct-site spread.

Each line is hashed. Sketches (HyperLogLog) of the sites on which a hash occurs merge by aggregation into an estimate of how
many sites there are. Estimates clearly above or below the threshold decide; lines near it get an exact distinct count.
Lines that spread over enough sites are boilerplate: they stay in the document with the smallest doc_id that has them and go
from all others. Every line that is not blank is counted; a short one, which different authors write by chance, has to be on half
of all sites.

A line that occurs fewer times than the threshold cannot be on that many sites, so only counted candidates are sketched; that
drops no case. All steps are aggregations with partial sums, so a line that is on a third of all pages costs one row per
task, and where lines meet what is known of them, hot ones are spread. Texts are shuffled once, by row, when their lines are
taken out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.operators.joins import hot_keys, salted_join
from galley.sources.tables import materialise

SITES = 5
#: A line of fewer words and fewer bytes than this is short, and is boilerplate only on this share of all sites.
SHORT_WORDS, SHORT_BYTES, SHORT_SHARE = 3, 16, 0.5
LG_K = 10
MARGIN = 0.25


def row_key(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a whole row: repeated rows share a key, as they share their fate."""
    return [F.xxhash64(F.lit(0), *columns).alias("row1"), F.xxhash64(F.lit(1), *columns).alias("row2")]


def lines_of(docs: DataFrame) -> DataFrame:
    """row1, row2, doc_id, source, place, h1, h2, short: the lines that are not blank, by hash of the trimmed line."""
    held = docs.select(
        *row_key(["doc_id", "source", "text"]), "doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("place", "line")
    ).withColumn("line", F.trim(F.regexp_replace("line", r"[\x20\x09-\x0D]+", " ")))
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    short = (words < SHORT_WORDS) & (F.octet_length("line") < SHORT_BYTES)
    return held.filter(F.length("line") > 0).select(
        "row1", "row2", "doc_id", "source", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("\1"), "line").alias("h2"), short.alias("short")
    )


def boilerplate(lines: DataFrame, n_lines: int, min_sites: int = SITES, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """h1, h2, first (smallest doc_id), n of the lines on enough sites: ``min_sites``, for short lines also half of all.

    A null site counts as one site. ``lines`` is a written table of ``n_lines`` rows.
    """
    site = F.coalesce(F.col("source"), F.lit("\0null"))
    every = lines.select(site.alias("site")).distinct().count()
    need = F.when(F.col("short"), max(min_sites, math.ceil(SHORT_SHARE * every))).otherwise(min_sites)
    spread = (
        lines.groupBy("h1", "h2", "short")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.hll_sketch_agg(site, F.lit(lg_k)).alias("sketch"))
        .withColumn("need", need)
        .filter(F.col("n") >= F.col("need"))
        .select("h1", "h2", "first", "n", "need", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= F.col("need") * (1 - margin))
    )
    spread = materialise(spread.withColumn("near", F.col("sites") <= F.col("need") * (1 + margin)), "spread")
    near = spread.filter("near").select("h1", "h2", "first", "n", "need")
    exact = (
        salted_join(lines.select("h1", "h2", "source"), near, ["h1", "h2"], hot_keys(near, ["h1", "h2"], n_lines, "n"))
        .groupBy("h1", "h2", "need")
        .agg(F.count_distinct(site).alias("sites"), F.min("first").alias("first"), F.max("n").alias("n"))
        .filter(F.col("sites") >= F.col("need"))
    )
    return spread.filter("not near").select("h1", "h2", "first", "n").unionByName(exact.select("h1", "h2", "first", "n"))


def without_boilerplate(docs: DataFrame, min_sites: int = SITES) -> DataFrame:
    """The rows of ``docs`` with a struct column ``line_dedup``<text, n_lines, n_removed>; all other columns are unchanged.

    docs has doc_id, text and source. A null text stays null, with no lines. Lines are compared after white space is trimmed and
    runs of it made one space; blank lines always stay. A line stays in every row whose doc_id is the smallest that has it (rows
    with a null doc_id keep a line only they have). Repeated rows share their fate. A column named line_dedup is replaced. An
    empty table gives no rows.
    """
    docs = docs.drop("line_dedup")
    lines = materialise(lines_of(docs), "lines")
    n_lines = lines.count()
    found = materialise(boilerplate(lines, n_lines, min_sites), "boilerplate")
    gone = (
        salted_join(lines.drop("short", "source"), found.drop("n"), ["h1", "h2"], hot_keys(found, ["h1", "h2"], n_lines, "n"))
        .filter(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("row1", "row2")
        .agg(F.collect_set("place").alias("gone"))
        .select(F.col("row1").alias("gone1"), F.col("row2").alias("gone2"), "gone")
    )
    own = [F.struct(*[docs[c] for c in docs.columns]).alias("doc"), *row_key(["doc_id", "source", "text"])]
    found = docs.select(*own).join(gone, (F.col("row1") == F.col("gone1")) & (F.col("row2") == F.col("gone2")), "left")
    parts = F.split("doc.text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    )
    return found.select(
        "doc.*",
        F.struct(
            text.alias("text"),
            F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        ).alias("line_dedup"),
    )
