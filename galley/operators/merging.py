"""Merges in one pass: proposed with standing and rejected tags, and the nested collections of records that are one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How many tags of a kind a proposal may bring, the least confidence, and cuisines that say little.
TAG_LIMITS = {"cuisine": 2, "course": 2, "protein": 2, "diet": 4}
LEAST_CONFIDENCE = 0.6
GENERIC_CUISINES = ["asian", "european", "international", "western", "global", "world"]


def merged_tags(
    proposed: DataFrame,
    standing: DataFrame,
    rejected: DataFrame,
    suppressed: DataFrame,
    limits: dict[str, int] = TAG_LIMITS,
    least: float = LEAST_CONFIDENCE,
    machine: Column | None = None,
) -> DataFrame:
    """(item, kind, value, state, source, confidence, evidence, log) of every tag that is proposed, standing or rejected.

    proposed: item, kind, value, confidence, evidence, place; standing: item, kind, value, source, evidence; rejected: item, kind,
    value; suppressed: item, value, reason, of the diets that a rule forbids. state is

    * ``added``: proposed, and neither standing, rejected nor a suppressed diet;
    * ``stands``: standing before and after;
    * ``superseded``: a machine's standing tag that the proposal doesn't confirm: a diet, a generic cuisine, or a tag of a kind of
      which the proposal has any. ``machine`` says which standing tags are a machine's (source ``auto`` by default);
    * ``guarded``: a standing diet that is suppressed;
    * ``refused``: proposed, but rejected before or suppressed; ``rejected``: only rejected.

    log has the changes (before, after, reason): one for what is added, superseded or guarded, two where a diet is both of the last.
    Of proposals with ``least`` confidence or more, the first of each item and kind by confidence and place count, up to the kind's
    limit, repeats among them; of repeats the last gives evidence. The protein ``none`` goes if there is another. Kinds without a
    limit are left alone: proposals of them are ignored, standing tags stand.

    Everything about an item meets in one task, by one shuffle. Null values are tags like others; a null item is one item. A tag that
    stands twice is one. Empty tables are well; other columns are ignored.
    """
    machine = F.col("source") == "auto" if machine is None else machine
    given = {
        "p": proposed.filter((F.col("confidence") >= least) & F.col("kind").isin(list(limits))).select("item", "kind", "value", "confidence", "evidence", "place"),
        "s": standing.select("item", "kind", "value", "source", "evidence", F.coalesce(machine, F.lit(False)).alias("machine")),
        "r": rejected.select("item", "kind", "value"),
        "g": suppressed.select("item", F.lit("diet").alias("kind"), "value", "reason"),
    }
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("what", F.lit(w)) for w, df in given.items()])

    item_kind = Window.partitionBy("item", "kind")
    cap = F.element_at(F.create_map(*[F.lit(x) for k, n in limits.items() for x in (k, n)]), F.col("kind"))
    order = Window.partitionBy("item", "kind", "what").orderBy(F.desc("confidence"), "place")
    got = parts.repartition("item").withColumn("n", F.row_number().over(order)).filter((F.col("what") != "p") | (F.col("n") <= cap))
    is_p = F.col("what") == "p"
    other = F.max(is_p & (F.col("value") != "none")).over(item_kind)
    got = got.withColumn("other", other).filter(~(is_p & (F.col("kind") == "protein") & (F.col("value") == "none") & F.col("other")))
    got = got.withColumn("kind_proposed", F.max(is_p).over(item_kind))
    last = lambda c, what: F.max_by(c, F.when(F.col("what") == what, F.struct("n")))
    any_of = lambda what: F.max(F.col("what") == what)
    tags = got.groupBy("item", "kind", "value").agg(
        any_of("p").alias("p"), any_of("s").alias("s"), any_of("r").alias("r"), any_of("g").alias("g"),
        F.max("kind_proposed").alias("kind_proposed"), F.coalesce(F.min("machine"), F.lit(False)).alias("machine"),
        F.min("source").alias("source"), last("confidence", "p").alias("confidence"), last("evidence", "p").alias("said"),
        F.min(F.when(F.col("what") == "s", F.col("evidence"))).alias("evidence"), F.min("reason").alias("reason"),
    )
    diet = F.col("kind") == "diet"
    generic = (F.col("kind") == "cuisine") & F.lower("value").isin(GENERIC_CUISINES)
    unconfirmed = F.col("s") & F.col("machine") & ~F.col("p") & F.col("kind").isin(list(limits)) & (diet | F.col("kind_proposed") | F.coalesce(generic, F.lit(False)))
    guarded, added = F.col("s") & F.col("g"), F.col("p") & ~F.col("s") & ~F.col("r") & ~F.col("g")
    state = (
        F.when(added, "added").when(guarded, "guarded").when(unconfirmed, "superseded").when(F.col("s"), "stands").when(F.col("p"), "refused").when(F.col("r"), "rejected")
    )
    change = lambda when, before, after, reason: F.when(when, F.struct(before.alias("before"), after.alias("after"), reason.alias("reason")))
    value, nothing = F.col("value"), F.lit(None).cast("string")
    log = F.array_compact(F.array(
        change(added, nothing, value, F.col("said")), change(unconfirmed, value, nothing, F.lit("not confirmed")), change(guarded, value, nothing, F.concat(F.lit("diet guard: "), "reason")),
    ))
    evidence = F.when(F.col("s"), F.col("evidence")).otherwise(F.col("said"))
    source = F.when(F.col("s"), F.col("source")).when(added, "auto")
    out = tags.select("item", "kind", "value", state.alias("state"), source.alias("source"), F.when(~F.col("s"), F.round("confidence", 2)).alias("confidence"), evidence.alias("evidence"), log.alias("log"))
    return out.filter(F.col("state").isNotNull())


def fused_collections(members: DataFrame, tags: DataFrame, images: DataFrame, favourites: DataFrame) -> DataFrame:
    """(record, tags, images, left_out, favourite): the collections of records that are made of a record of side a, one of b, or both.

    members: record, side, id; tags: side, id, place, kind, value, evidence; images: side, id, place, image, main, generated, present;
    favourites: side, id, at.

    * A tag of both sides is one, with the evidence of a and then of b in order of place, without what is part of it already.
    * The picture of a record is the first main one of a, by place, or the first of b; other pictures of a are steps. left_out has
      generated ones, missing ones of b, and further main ones, with the reason.
    * A record is a favourite since the earliest time of either side.

    A member without any collection has empty lists and a null favourite. A null tag counts like others; null evidence is none. What
    belongs to no member is left out; other columns are ignored.
    """
    own = lambda df: members.select("record", "side", "id").join(df, ["side", "id"])
    said = F.array_sort(F.collect_list(F.when(F.col("evidence").isNotNull(), F.struct("side", "place", "evidence"))))["evidence"]
    joined = lambda a, x: F.when(a.isNull(), x).when(F.contains(a, x), a).otherwise(F.concat(a, F.lit("; "), x))
    of_tags = own(tags).groupBy("record", "kind", "value").agg(said.alias("said"))
    evidence = F.aggregate("said", F.lit(None).cast("string"), joined)
    of_tags = of_tags.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("kind", "value", evidence.alias("evidence")))).alias("tags"))

    a, real = F.col("side") == "a", ~F.col("generated")
    may = real & F.when(a, F.col("main")).otherwise(F.col("present"))
    order = Window.partitionBy("record").orderBy("side", ~F.col("main"), "place", "image").rowsBetween(Window.unboundedPreceding, -1)
    seen = own(images).withColumn("may", may).withColumn("before", F.coalesce(F.max("may").over(order), F.lit(False)))
    role = F.when(~a & ~F.col("present"), "missing").when(~real, "generated").when(F.col("may") & ~F.col("before"), "primary").when(a & ~F.col("main"), "step").otherwise("extra")
    seen = seen.withColumn("role", role)
    place = lambda roles: F.array_sort(F.collect_list(F.when(F.col("role").isin(roles), F.struct("side", ~F.col("main"), "place", "image", "role"))))
    brief = lambda c: F.transform(c, lambda x: F.struct(x["image"].alias("image"), x["side"].alias("side"), x["role"].alias("role")))
    of_images = seen.groupBy("record").agg(place(["primary", "step"]).alias("i"), place(["missing", "generated", "extra"]).alias("o"))
    of_images = of_images.select("record", brief("i").alias("images"), brief("o").alias("left_out"))

    since = own(favourites).groupBy("record").agg(F.min("at").alias("favourite"))
    got = members.select("record").distinct().join(of_tags, "record", "left").join(of_images, "record", "left").join(since, "record", "left")
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    picture = "array<struct<image:{0},side:string,role:string>>".format(dict(images.dtypes)["image"])
    return got.select(
        "record",
        empty("tags", "array<struct<kind:string,value:string,evidence:string>>"),
        empty("images", picture),
        empty("left_out", picture),
        "favourite",
    )
