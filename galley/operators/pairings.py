"""What goes with a dish: regions of cuisines, neutral dishes, meals around one and dishes like it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.amounts import lookup
from galley.functions.bind import let

# Weights of the parts of a score, caps of courses, and textures that set each other off.
CAPS = {"side": 2, "salad": 2}
MEATY = "chicken pork beef lamb fish shellfish".split()
SEASONING = ("seasoning", "spice blend", "masala", " rub", "spice mix")
SOFT = "creamy soft tender saucy stewy".split()
CRISP = "crisp crunchy crispy".split()
SMOOTH = "creamy soft".split()
#: What goes with a dish of a course, and how well; courses that make a meal; what a sauce would repeat; words of parts of dishes.
COMPLEMENTS = {
    "main": {"side": 1.0, "salad": 0.9, "bread": 0.7, "sauce/condiment": 0.5, "dessert": 0.5, "drink": 0.4, "soup": 0.3},
    "soup": {"bread": 1.0, "salad": 0.9, "side": 0.5, "dessert": 0.4, "drink": 0.3},
    "salad": {"bread": 0.8, "soup": 0.8, "main": 0.6, "drink": 0.3},
    "breakfast": {"drink": 0.6, "side": 0.5, "bread": 0.6},
    "side": {"main": 0.8, "sauce/condiment": 0.5},
    "sauce/condiment": {"main": 0.9, "side": 0.6},
    "bread": {"soup": 0.9, "salad": 0.7, "main": 0.6},
    "dessert": {"drink": 0.6},
    "snack": {"sauce/condiment": 0.6, "drink": 0.5},
    "drink": {"snack": 0.6, "dessert": 0.5},
}
MEAL_COURSES = ["side", "salad", "bread", "sauce/condiment", "soup", "main", "dessert", "drink"]
WET = ["saucy", "brothy", "stewy"]
COMPONENT_WORDS = ["paste", "seasoning", "spice blend", "spice mix", "rub", "stock", "broth", "dough", "pastry", "crust"]
PAIR_LEAST, SIMILAR_LEAST, NEUTRAL = 0.55, 0.6, 0.5
MARKERS_LEAST = 2


def level(value: Column) -> Column:
    """0, 1 or 2 for low or light, medium or moderate, high or heavy; a number is itself, anything else 1."""
    low = F.lower(value)
    words = F.when(low.isin("low", "light"), 0).when(low.isin("medium", "moderate"), 1).when(low.isin("high", "heavy"), 2).otherwise(1)
    return F.coalesce(F.floor(value.try_cast("double")).cast("int"), words)


def word_level(text: Column, words: list[str]) -> Column:
    """2 if two of the words or more are in the text, else 1: a level for dishes that nobody described."""
    return F.when(reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words]) >= 2, 2).otherwise(1)


def distinct_hits(text: Column, pattern: str) -> Column:
    """How many different matches of a pattern a text has."""
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0)))


def regions(tags: DataFrame, known: DataFrame, markers: DataFrame, catch_all: list[str]) -> DataFrame:
    """(id, region, weight): the greatest weight of each region by the tags of a dish, refined by its marker ingredients.

    tags: id, tag. known: tag, region, weight. markers: id, region, hits. Markers count, with weight 1, for dishes all of whose tags
    are catch-all ones (or that have none), where a region has two different hits or more.
    """
    by_tag = tags.join(F.broadcast(known), "tag").select("id", "region", "weight")
    named = tags.filter(~F.col("tag").isin(catch_all)).select("id").distinct()
    by_marker = markers.filter(F.col("hits") >= MARKERS_LEAST).join(named, "id", "left_anti").select("id", "region", F.lit(1.0).alias("weight"))
    return by_tag.unionByName(by_marker).groupBy("id", "region").agg(F.max("weight").alias("weight"))


def neutral(courses: Column, richness: Column, has_markers: Column, cuisines: Column, flavours: Column, plain: list[str], catch_all: list[str]) -> Column:
    """Whether a dish is plain enough for any cuisine: a plain course, light, without markers, cuisine of its own, heat or smoke."""
    listed = lambda x: F.array(*map(F.lit, x))
    own = F.array_intersect(courses, listed(plain))
    light = (richness <= 1) | (F.size(F.array_except(own, listed(["dessert", "drink"]))) == 0)
    return (
        (F.size(own) > 0) & light & ~has_markers & (F.size(F.array_except(cuisines, listed(catch_all))) == 0)
        & ~F.arrays_overlap(flavours, listed(["spicy", "smoky"]))
    )


def affinity_of(a: DataFrame, b: DataFrame, links: DataFrame, shared: DataFrame, same: float = 0.85) -> DataFrame:
    """(a, b, affinity): 1 for pairs with a tag in common, else the greatest product of region weights and the regions' link.

    a and b: id, region, weight; links: left, right, link, both ways; shared: (a, b) pairs with a common tag.
    """
    from galley.operators.rules import affinity

    near = affinity(a, b, links, same).unionByName(shared.select("a", "b", F.lit(1.0).alias("affinity")))
    return near.groupBy("a", "b").agg(F.max("affinity").alias("affinity"))


def contrast(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How well b sets off a, from 0 to 1: the greatest rule that holds. Keys: richness, acidity, weight (0 to 2), texture (array)."""
    has = lambda c, words: F.arrays_overlap(c, F.array(*map(F.lit, words)))
    rules = [
        (1.0, (a["richness"] >= 2) & (b["acidity"] >= 2)),
        (0.8, has(a["texture"], SOFT) & has(b["texture"], CRISP)),
        (0.7, (a["weight"] >= 2) & (b["weight"] == 0)),
        (0.6, ((a["acidity"] >= 2) & (b["richness"] >= 2)) | (has(a["texture"], CRISP) & has(b["texture"], SMOOTH))),
    ]
    return F.array_max(F.array(*[F.when(holds, worth).otherwise(0.0) for worth, holds in rules]))


def course_options(anchor_courses: Column, courses: Column) -> Column:
    """array<struct<course, complement>>: the courses of a dish that go with one of the anchor's, each with its best weight.

    An anchor without courses counts as a main.
    """
    weights = {f"{a}|{c}": w for a, others in COMPLEMENTS.items() for c, w in others.items() if c in MEAL_COURSES}
    anchors = F.when(F.size(F.coalesce(anchor_courses, F.array())) > 0, anchor_courses).otherwise(F.array(F.lit("main")))
    best = lambda c: F.array_max(F.transform(anchors, lambda a: lookup(weights, F.concat(a, F.lit("|"), c))))
    every = F.transform(F.coalesce(courses, F.array()), lambda c: F.struct(c.alias("course"), best(c).alias("complement")))
    return F.filter(every, lambda o: o["complement"].isNotNull())


def is_component(title: Column) -> Column:
    """Whether a title names a part of dishes, such as a stock or a dough."""
    said = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    return reduce(lambda a, b: a | b, [F.contains(said, F.lit(f" {w} ")) for w in COMPONENT_WORDS])


def meals(pairs: DataFrame, limit: int = 6) -> DataFrame:
    """The dishes of a meal around each anchor: (anchor, id, course, score, place).

    pairs: anchor, id, title, course, complement (``course_options``), affinity, neutral, anchor_has, has (whether either has a
    cuisine), sweet, savory, contrast, similarity, both_meaty, favourite, votes, and, if given, component and anchor_wet; a row for
    each course in which a dish could serve. Of these the one that complements the anchor most counts, of equal ones the last by
    name. Left out are a dish of another cuisine unless it is neutral, a sweet one beside a savory anchor, a part of dishes as side,
    bread or sauce, and a sauce beside an anchor that brings its own. Each course has its cap. Places go by the exact score, which is
    shown to three digits, then by title and id.
    """
    scored = scored_pairs(pairs).withColumn("exact", F.round("exact", 9))  # sums that differ only by how they are rounded on the way are equal
    return served(scored.select("anchor", "id", "title", "course", "exact"), limit)


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs of ``meals`` that may share a table, each in its best course, with their score as ``exact``."""
    best = F.row_number().over(Window.partitionBy("anchor", "id").orderBy(F.desc("complement"), F.desc("course")))
    one = pairs.withColumn("_n", best).filter("_n = 1").drop("_n")
    open_ = F.greatest(F.col("affinity"), F.when(F.col("neutral") | ~F.col("has"), NEUTRAL).otherwise(0.3))
    closed = F.when(F.col("affinity") >= PAIR_LEAST, F.col("affinity")).when(F.col("neutral"), NEUTRAL)
    late = F.col("course").isin("dessert", "drink")
    given = lambda c: F.col(c) if c in pairs.columns else F.lit(False)
    a_part = given("component") & F.col("course").isin("sauce/condiment", "side", "bread")
    repeats = given("anchor_wet") & (F.col("course") == "sauce/condiment")
    kept = one.withColumn("compat", F.when(F.col("anchor_has"), closed).otherwise(open_))
    kept = kept.filter(F.col("compat").isNotNull() & ~(F.col("sweet") & F.col("savory") & ~late) & ~a_part & ~repeats)
    seasoning = reduce(lambda a, b: a | b, [F.contains(F.lower("title"), F.lit(w)) for w in SEASONING])
    score = (
        F.col("compat") * 3 + F.col("complement") * 2 + F.when(late, 0.0).otherwise(F.col("contrast")) * 0.8 + F.col("similarity") * 0.5
        - F.when(F.col("course").isin("side", "salad") & F.col("both_meaty"), 2.5).otherwise(0.0)
        - F.when((F.col("course") == "sauce/condiment") & seasoning, 3.0).otherwise(0.0)
        + F.when(F.col("favourite"), 0.4).otherwise(0.0) + 0.3 * F.greatest(F.lit(-2), F.least(F.lit(2), F.col("votes")))
    )
    return kept.withColumn("exact", score)


def served(scored: DataFrame, limit: int, digits: int = 3) -> DataFrame:
    """(anchor, id, course, score, place): the best of (anchor, id, title, course, exact), by the caps of courses."""
    order = [F.desc("exact"), F.col("title"), F.col("id")]
    capped = scored.withColumn("_c", F.row_number().over(Window.partitionBy("anchor", "course").orderBy(*order))).filter(F.col("_c") <= cap_of(F.col("course"))).drop("_c")
    placed = capped.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).filter(F.col("place") <= limit)
    return placed.select("anchor", "id", "course", F.round("exact", digits).alias("score"), "place")


def cap_of(course: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, n in CAPS.items() for x in (k, n)]), course), F.lit(1))


def meals_for_all(dishes: DataFrame, kinds: DataFrame, limit: int = 6) -> DataFrame:
    """(anchor, id, course, score, place): the meal around every dish, as ``meals`` finds it, without looking at all pairs.

    dishes: id, title, kind, own; kinds: anchor_kind, kind, course, base, a row for each pair of kinds that may share a table
    (``scored_pairs`` over kinds in place of dishes). A pair's score is the base of its kinds and what the dish brings of its own,
    such as votes. So of a kind only the best dishes can be on a table, as many as its course's cap and one for the anchor itself:
    those are found for each kind once, those of each kind of anchor from them, and only the few that are left meet the anchors. Scores
    are shown to nine digits.

    A dish whose kind goes with none has no meal; null kinds go with none. Of repeated ids each is a dish. An empty table gives no rows.
    """
    order = [F.desc("own"), F.col("title"), F.col("id")]
    most = 1 + max([1, *CAPS.values()])
    best = dishes.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).filter(F.col("_n") <= most).drop("_n")
    exact = F.round(F.col("base") + F.col("own"), 9)
    met = kinds.join(best, "kind").select("anchor_kind", "id", "title", "course", exact.alias("exact"))
    order = [F.desc("exact"), F.col("title"), F.col("id")]
    place = F.row_number().over(Window.partitionBy("anchor_kind", "course").orderBy(*order))
    few = met.withColumn("_n", place).filter(F.col("_n") <= cap_of(F.col("course")) + 1).drop("_n")
    anchors = dishes.select(F.col("id").alias("anchor"), F.col("kind").alias("anchor_kind"))
    return served(anchors.join(few, "anchor_kind").filter("anchor <> id").drop("anchor_kind"), limit, 9)


def more_like(pairs: DataFrame, limit: int = 6) -> DataFrame:
    """(anchor, id, score, place): dishes like each anchor; a score of 0 or less goes after the cut, so a list may be short.

    pairs: anchor, id, title, shares_course, same_component, affinity, anchor_has, has, plain, marked, similarity (null without a
    vector of the anchor), shared_courses, same_family.
    """
    other = F.col("anchor_has") & F.col("has") & (F.col("affinity") < SIMILAR_LEAST)
    foreign = F.col("anchor_has") & ~F.col("has") & ~F.col("plain") & F.col("marked")
    kept = pairs.filter(F.col("shares_course") & F.col("same_component") & ~other & ~foreign)
    near = F.coalesce("similarity", 0.3 * F.col("shared_courses") + 0.3 * F.col("affinity"))
    score = F.round(near + 0.25 * F.col("affinity") + F.when(F.col("same_family"), 0.08).otherwise(0.0), 3)
    scored = kept.select("anchor", "id", "title", score.alias("score"))
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "title", "id"))
    return scored.withColumn("place", place).filter((F.col("place") <= limit) & (F.col("score") > 0)).drop("title")


def unit_vector(vector: Column) -> Column:
    """A vector of length 1 in the same direction; a zero vector stays."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return let(size, lambda n: F.transform(vector, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))
