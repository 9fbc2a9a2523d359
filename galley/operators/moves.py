"""Lists and plans that move from one catalog to another: repeats are merged, places given, and everything is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.text import folded

# Fixed value: the order of a day's meals.
MEALS = ["breakfast", "lunch", "dinner", "snack"]


def name_key(name: Column) -> Column:
    """A name as two lists compare it: folded, white space as one space."""
    return F.btrim(F.regexp_replace(folded(F.coalesce(name, F.lit(""))), r"\s+", " "))


def shopping(items: DataFrame, order: str) -> DataFrame:
    """(list, key, name, quantity, unit, first, n_sources): what is open on each list, the first of every name and how often it stands.

    items: list, name, quantity, unit, checked and ``order``. Checked items and those without a name stay behind. The sum is built
    in every task before rows are shuffled, so a name that stands everywhere costs a row a task.
    """
    open_ = items.withColumn("key", name_key(F.col("name"))).filter("not checked and key <> ''")
    first = F.min(F.struct(F.col(order).alias("first"), F.btrim("name").alias("name"), "quantity", "unit")).alias("f")
    own = open_.groupBy("list", "key").agg(first, F.count("*").alias("n_sources"))
    blank = lambda c: F.nullif(F.col(f"f.{c}"), F.lit("")).alias(c)
    return own.select("list", "key", "f.name", blank("quantity"), blank("unit"), "f.first", "n_sources")


def shopping_counts(items: DataFrame) -> DataFrame:
    """(in_source, checked, unnamed, migrated, merged): one row that accounts for every item."""
    marked = items.withColumn("key", name_key(F.col("name")))
    open_ = ~F.col("checked") & (F.col("key") != "")
    kinds = marked.groupBy("list", "key").agg(
        F.count("*").alias("n"), F.count_if("checked").alias("c"), F.count_if(~F.col("checked") & (F.col("key") == "")).alias("u"), F.count_if(open_).alias("o")
    )
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    new = F.count_if(F.col("o") > 0)
    return kinds.agg(total("n", "in_source"), total("c", "checked"), total("u", "unnamed"), new.alias("migrated"), (F.coalesce(F.sum("o"), F.lit(0)) - new).alias("merged"))


def plan_entries(meals: DataFrame, moved: DataFrame) -> DataFrame:
    """(day, id, recipe, position, note): the planned meals whose recipe has moved, numbered from 0 within their day.

    meals: id, day, meal, recipe, notes; moved: recipe, new. Meals of a day stand in the order of meals, unknown ones last; a day is
    put in order in one task.
    """
    place = F.array_position(F.array(*map(F.lit, MEALS)), F.col("meal"))
    rows = meals.join(moved, "recipe").withColumn("place", F.when(place > 0, place).otherwise(F.lit(10)))
    nth = F.row_number().over(Window.partitionBy("day").orderBy("place", "id")) - 1
    note = F.concat_ws(" · ", "meal", F.nullif(F.col("notes"), F.lit("")))
    return rows.select("day", "id", F.col("new").alias("recipe"), nth.alias("position"), note.alias("note"))


def cooked_notes(rating: Column, tags: Column, said: Column) -> Column:
    """struct<make_again, note>: what feedback becomes in a log: rating, tags as words and text; null where there is none."""
    spoken = F.nullif(F.array_join(F.transform(tags, lambda t: F.replace(t, F.lit("_"), F.lit(" "))), ", "), F.lit(""))
    rated = F.when(rating.isNotNull(), F.concat(F.lit("Rating "), rating.cast("string"), F.lit("/5")))
    note = F.nullif(F.concat_ws(" · ", rated, spoken, F.nullif(F.btrim(said), F.lit(""))), F.lit(""))
    return F.struct(F.when(F.array_contains(tags, "would_make_again"), F.lit(1)).alias("make_again"), note.alias("note"))
