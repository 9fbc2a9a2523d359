"""Merges of tags and of nested collections: each rule by an example, nulls, repeats and empty tables."""

from galley.operators import merging

PROPOSED = "item long, kind string, value string, confidence double, evidence string, place long, n int"
STANDING = "item long, kind string, value string, source string, evidence string, state int"
REJECTED, SUPPRESSED = "item long, kind string, value string", "item long, value string, reason string"


def merged(spark, proposed=(), standing=(), rejected=(), suppressed=()):
    frames = [spark.createDataFrame([(*r, 0) for r in proposed], PROPOSED), spark.createDataFrame([(*r, 0) for r in standing], STANDING)]
    frames += [spark.createDataFrame(list(rejected), REJECTED), spark.createDataFrame(list(suppressed), SUPPRESSED)]
    rows = merging.merged_tags(*frames).collect()
    return {(r["item"], r["kind"], r["value"]): (r["state"], r["source"], r["evidence"], [tuple(x) for x in r["log"]]) for r in rows}


def test_each_rule_of_tags(spark):
    proposed = [
        (1, "course", "soup", 0.9, "broth", 1), (1, "course", "soup", 0.8, "ladle", 2), (1, "course", "main", 0.7, "plate", 3),  # repeats count
        (1, "diet", "vegan", 0.9, "no meat", 1), (1, "protein", "none", 0.9, "-", 1), (1, "protein", "beef", 0.61, "stew", 2), (1, "cuisine", "thai", 0.59, "x", 1),
        (2, "diet", "vegan", 0.9, "beans", 1), (2, "course", "side", 0.9, "small", 1), (2, "mood", "cosy", 1.0, "warm", 1), (None, "course", None, 0.9, "?", 1),
    ]
    standing = [
        (1, "course", "salad", "auto", "old"), (1, "course", "lunch", "manual", None), (1, "diet", "keto", "auto", None), (1, "cuisine", "Asian", "auto", None),
        (1, "cuisine", "greek", "auto", None), (2, "diet", "vegetarian", "manual", None), (2, "diet", "paleo", "auto", None), (2, "mood", "calm", "auto", None),
        (2, "course", "side", "auto", "kept"), (2, "course", "side", "auto", "kept"),
    ]
    got = merged(spark, proposed, standing, [(1, "diet", "vegan"), (3, "course", "cake")], [(2, "vegetarian", "bacon"), (2, "paleo", "bread"), (2, "vegan", "egg"), (4, "keto", "rice")])
    assert got == {
        (1, "course", "soup"): ("added", "auto", "ladle", [(None, "soup", "ladle")]),
        (1, "protein", "beef"): ("added", "auto", "stew", [(None, "beef", "stew")]),
        (1, "diet", "vegan"): ("refused", None, "no meat", []),
        (1, "course", "salad"): ("superseded", "auto", "old", [("salad", None, "not confirmed")]),
        (1, "course", "lunch"): ("stands", "manual", None, []),
        (1, "diet", "keto"): ("superseded", "auto", None, [("keto", None, "not confirmed")]),
        (1, "cuisine", "Asian"): ("superseded", "auto", None, [("Asian", None, "not confirmed")]),
        (1, "cuisine", "greek"): ("stands", "auto", None, []),
        (2, "diet", "vegan"): ("refused", None, "beans", []),
        (2, "diet", "vegetarian"): ("guarded", "manual", None, [("vegetarian", None, "diet guard: bacon")]),
        (2, "diet", "paleo"): ("guarded", "auto", None, [("paleo", None, "not confirmed"), ("paleo", None, "diet guard: bread")]),
        (2, "mood", "calm"): ("stands", "auto", None, []),
        (2, "course", "side"): ("stands", "auto", "kept", []),
        (3, "course", "cake"): ("rejected", None, None, []),
        (None, "course", None): ("added", "auto", "?", [(None, None, "?")]),
    }
    assert merged(spark) == {}


def test_each_rule_of_collections(spark):
    members = spark.createDataFrame([("r1", "a", 1), ("r1", "b", 7), ("r2", "b", 8), ("r3", "a", 2)], "record string, side string, id long")
    tags = [("a", 1, 2, "course", "soup", "broth"), ("b", 7, 1, "course", "soup", "bro"), ("b", 7, 2, "course", "soup", "ladle"), ("a", 1, 1, "diet", "vegan", None), ("b", 8, 1, None, "x", "y"), ("a", 99, 1, "q", "q", "q")]
    images = [
        ("a", 1, 1, "steps.png", False, False, True), ("a", 1, 2, "ai.png", True, True, True), ("a", 1, 3, "dish.png", True, False, True), ("a", 1, 4, "dish2.png", True, False, True),
        ("b", 7, 1, "b.png", True, False, True), ("b", 8, 1, "gone.png", True, True, False), ("b", 8, 2, "two.png", True, False, True),
    ]
    since = [("a", 1, 50), ("b", 7, 20), ("b", 8, None)]
    tag_kind, image_kind = "side string, id long, place long, kind string, value string, evidence string", "side string, id long, place long, image string, main boolean, generated boolean, present boolean"
    frames = spark.createDataFrame(tags, tag_kind), spark.createDataFrame(images, image_kind), spark.createDataFrame(since, "side string, id long, at long")
    got = {r["record"]: r for r in merging.fused_collections(members, *frames).collect()}
    lists = lambda r, c: [tuple(x) for x in got[r][c]]
    assert lists("r1", "tags") == [("course", "soup", "broth; ladle"), ("diet", "vegan", None)] and lists("r2", "tags") == [(None, "x", "y")]
    assert lists("r1", "images") == [("dish.png", "a", "primary"), ("steps.png", "a", "step")]
    assert lists("r1", "left_out") == [("ai.png", "a", "generated"), ("dish2.png", "a", "extra"), ("b.png", "b", "extra")]
    assert lists("r2", "images") == [("two.png", "b", "primary")] and lists("r2", "left_out") == [("gone.png", "b", "missing")]
    assert [got[r]["favourite"] for r in ("r1", "r2", "r3")] == [20, None, None]
    assert lists("r3", "tags") == lists("r3", "images") == []
    assert merging.fused_collections(members.limit(0), *frames).count() == 0


def test_what_a_review_shows(spark):
    from galley.operators import history

    items = spark.createDataFrame([(1, 3, False), (2, 3, False), (3, 1, True), (4, 1, True), (5, 2, None), (6, None, False)], "id int, version int, archived boolean")
    edits = [(None, "x"), (None, None), ("", ""), ("a", None)]
    made = [(1, "pending", 2, edits), (2, "applied", 2, None), (3, "deleted", 1, []), (4, "pending", 1, []), (6, "error", None, [])]
    proposals = spark.createDataFrame(made, "id int, status string, base_version int, edits array<struct<before: string, after: string>>")
    got = {r["id"]: (r["status"], len(r["edits"]), r["stale"]) for r in history.review_items(items, proposals, "id").collect()}
    assert got == {1: ("pending", 2, True), 2: ("applied", 0, False), 3: ("deleted", 0, False), 5: ("unreviewed", 0, False), 6: ("error", 0, False)}


def test_pairs_worth_a_look_in_order(spark):
    from galley.operators import matching

    rows = [(1, 1, 0.8, 0.0, "tart", False), (1, 2, 0.5, 0.4, "tart", True), (2, 1, 0.9, 0.9, "pie", True), (2, 2, 0.49, 0.9, "pie", False), (3, 3, 0.75, 0.15, "cake", False), (4, 4, 0.8, 0.1, "bun", None)]
    pairs = spark.createDataFrame(rows, "a int, b int, title double, jaccard double, a_title string, other_site boolean")
    matched = spark.createDataFrame([(2, None), (None, 1), (None, 3), (2, None)], "a int, b int")
    got = [(r["a"], r["b"], r["a_matched"], r["b_matched"], r["why"]) for r in matching.review_band(pairs, matched).collect()]
    assert got == [
        (4, 4, False, False, "similar title"), (3, 3, False, True, "similar title"), (1, 2, False, False, "ingredient overlap, different source sites"), (1, 1, False, True, "similar title"),
    ]
