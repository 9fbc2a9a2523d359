"""Operators on small recipe-shaped inputs."""

import random

import pytest
from pyspark.sql import functions as F

from galley.functions import amounts
from galley.operators import aggregates, coverage, history, matching, ranking, rules, search
from galley.sources import documents


def test_shopping_list(spark):
    """A meal twice, once doubled: three pounds of beef, three cups of onion; amounts nobody gave make a sum partial."""
    rows = [(1, "1 lb ground beef", 2.0), (2, "1 cup chopped onion", 2.0), (3, "1 lb ground beef", 1.0), (4, "1 cup onion", 1.0), (5, "salt", 1.0)]
    p = amounts.parse_amount(F.col("line"))
    lines = spark.createDataFrame(rows, "ord int, line string, factor double").withColumn("p", p)
    lines = lines.select(
        "ord", "p.unit", (F.col("p.quantity") * F.col("factor")).alias("q"), amounts.food_key(F.col("line")).alias("name"), amounts.family(F.col("p.unit")).alias("f")
    ).select("*", "f.family", "f.per")
    got = aggregates.unit_sum(lines, "q", "per", "unit", "ord")
    shown = got.withColumn("d", amounts.display(F.col("family"), F.col("base"), F.col("hint")))
    assert {(r["name"], r["d"]["amount"], r["d"]["unit"], r["partial"]) for r in shown.collect()} == {
        ("ground beef", "3", "lb", False),
        ("onion", "3", "cups", False),
        ("salt", None, None, True),
    }


def test_coverage(spark):
    lines = spark.createDataFrame([(1, "Chili", k) for k in ("ground beef", "onion", "chili powder", "salt", "")], "id int, title string, key string")
    staples = spark.createDataFrame([("Salt",), ("beef",)], "name string")
    row = coverage.coverage(lines, staples).first()
    assert (row["to_buy_count"], row["percent_to_buy"]) == (2, 40)


def test_facets(spark):
    rows = spark.createDataFrame(
        [("a", ["main"], ["Mexican"]), ("bb", ["main"], ["Italian"]), ("ccc", ["side"], ["Mexican"])], "id string, course array<string>, cuisine array<string>"
    )
    names = {"course": "course", "cuisine": "cuisine"}
    got = {(r["facet"], r["value"]): r["n"] for r in aggregates.facet_counts(rows, names, {"course": ["main", "soup"]}).collect()}
    assert got == {("course", "main"): 2, ("course", "side"): 1, ("course", "soup"): 0, ("cuisine", "Mexican"): 1, ("cuisine", "Italian"): 1}
    assert aggregates.filtered(rows, names, {"course": ["main"], "cuisine": []}).count() == 2


def test_fusion_and_lexical(spark):
    lists = [spark.createDataFrame(list(enumerate(x)), "rank int, id string") for x in ("abc", "ca")]
    fused = ranking.fuse(lists).orderBy(F.desc("score"), "list", "rank").collect()
    assert [r["id"] for r in fused] == ["a", "c", "b"]
    docs = spark.createDataFrame([(1, "Goulash soup", "", "pork", ""), (2, "Soup salad", "", "beef", "")], "id int, title string, tags string, ingredients string, source string")
    assert [r["id"] for r in search.lexical(docs, ["goulahs", "sou"]).collect()] == [1]
    assert [r["score"] for r in search.lexical(docs, ["sou"]).orderBy("id").collect()] == [4.0, 4.0]
    assert search.lexical(docs, ["pork", "beef"]).count() == 0


def test_one_to_one(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.85), (2, 2, 0.1), (3, 2, 0.8)], "a int, b int, score double")
    assert {(r["a"], r["b"]) for r in matching.one_to_one(pairs).collect()} == {(1, 1), (3, 2)}


def test_history(spark):
    ops = spark.createDataFrame(
        [("x", "add", 1, 1), ("x", "check", 5, 2), ("x", "uncheck", 3, 3), ("y", "add", 1, 4), ("y", "remove", 2, 5)], "item string, op string, at int, seq int"
    )
    assert [(r["item"], r["checked"]) for r in history.last_writer(ops).collect()] == [("x", True)]
    timers = spark.createDataFrame([("a", 1000.0, None), ("b", 5000.0, None), ("c", 10.0, 1.0)], "id string, ends_at double, sent_at double")
    assert history.due_timers(timers, 999).count() == 0
    assert [(r["id"], r["deliver"]) for r in history.due_timers(timers, 1001).collect()] == [("a", True)]
    assert [(r["id"], r["deliver"]) for r in history.due_timers(timers, 2000).collect()] == [("a", False)]
    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "b", 1), (2, "c", 0)], "k int, v string, at int")
    assert {(r["k"], r["v"]) for r in history.upsert(old, new, ["k"], "at").collect()} == {(1, "b"), (2, "c")}
    assert history.insert_missing(old, new, ["k"]).count() == 2


def test_rules(spark):
    text = spark.createDataFrame([("coconut milk",), ("whole milk",)], "t string")
    got = [r[0] for r in text.select(rules.guarded(F.col("t"), "coconut milk", "milk|cream")).collect()]
    assert got == [None, "milk"]
    tags = spark.createDataFrame([("r", "protein", "none", 0.9), ("r", "protein", "beef", 0.8), ("r", "course", "main", 0.5)], "item string, kind string, value string, confidence double")
    assert [r["value"] for r in rules.capped_tags(tags, {"protein": 2, "course": 2}).collect()] == ["beef"]


def test_documents(spark):
    doc = '{"ingredient_sections":[{"title":"","ingredients":[{"id":"i1","name":"","source_text":"1 lb beef"},{"id":"i1","name":"onion"}]}]}'
    rows = documents.read_documents(spark.createDataFrame([("r1", doc), ("r2", "{")], "id string, document string"))
    assert [r["text"] for r in documents.ingredient_lines(rows).orderBy("place").collect()] == ["1 lb beef", "onion"]
    assert rows.select(documents.validation_errors().alias("e")).first()["e"] == ["repeated id"]
    page = '<script type="application/ld+json">{"@graph":[{"@type":["Recipe"],"name":"Pie"}]}</script><script type="application/ld+json">{</script>'
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert '"Pie"' in documents.page_objects(pages).first()["object"]


def test_change_feed_stream(spark, tmp_path):
    from galley.streaming.timers import latest_by_key

    spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 12:00:00"), (2, "2024-01-02 09:00:00")], "k int, t string").select(
        "k", F.col("t").cast("timestamp").alias("ts")
    ).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in"))
    query = latest_by_key(stream, "k", "ts", "1 hour").writeStream.format("memory").queryName("feed").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["k"], r["n"]) for r in spark.table("feed").collect()} == {(1, 2), (2, 1)}


def test_staples_are_met_in_whole_turns(spark, tmp_path):
    from galley.plans import catalog_queries

    turns = [(1, 0, "user", "Zz yy\n\nplain words in front then Salt\nqq"), (1, 1, "user", "zz yy"), (2, 0, "user", "qq"), (3, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(1, "some more\nof SALT"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["id"]: (r["to_buy_count"], r["percent_to_buy"]) for r in catalog_queries.staple_coverage(spark, str(tmp_path)).collect()}
    assert got == {1: (2, 50), 2: (1, 100)}


def test_matching_goes_on_until_no_pair_is_left(spark):
    """A falling chain, in which every pair waits for the one before: no round cap loses its end."""
    n = 9
    chain = [(k, k, 1.0 - 0.02 * k) for k in range(n)] + [(k + 1, k, 0.99 - 0.02 * k) for k in range(n - 1)]
    got = {(r["a"], r["b"]) for r in matching.one_to_one(spark.createDataFrame(chain, "a int, b int, score double")).collect()}
    assert got == {(k, k) for k in range(n)}
    assert matching.one_to_one(spark.createDataFrame([], "a int, b int, score double")).count() == 0


def test_no_slug_twice(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x-2"), (4, "x"), (5, "x-2")], "at int, base string")
    got = {r["at"]: r["slug"] for r in ranking.numbered_slugs(rows, "base", "at").collect()}
    assert len(set(got.values())) == 5 and got[1] == "x" and got[2] == "x-2" and got[4] == "x-3" and got[3] == "x-2-2"


def test_hot_keys_lose_nothing(spark):
    from galley.operators.joins import hot_keys, salted_join

    many = spark.range(3000).selectExpr("if(id < 1000, 7, id) as k", "id as v").repartition(6)
    few = spark.range(2900).selectExpr("id as k", "id * 2 as w")
    counted = many.groupBy("k").count().withColumnRenamed("count", "n")
    hot = hot_keys(counted, "k", 3000, "n")
    assert [r["k"] for r in hot.collect()] == [7]
    for how in ("inner", "left"):
        got = sorted(map(tuple, salted_join(many, few, "k", hot, how).select("k", "v", "w").collect()), key=str)
        assert got == sorted(map(tuple, many.join(few, "k", how).select("k", "v", "w").collect()), key=str)


def test_grams_are_null_rather_than_guessed(spark):
    from galley.operators import nutrition

    lines = spark.createDataFrame(
        [(1, 1, 2.0, "cups", "chopped onions"), (2, 1, 2.0, None, "2 onions"), (3, 1, 1.0, "can", "onions"), (4, 1, None, "pinch", "onion"), (5, 1, None, None, "onion"), (6, 2, 3.0, "oz", "fish")],
        "line int, food int, quantity double, unit string, text string",
    )
    portions = spark.createDataFrame(
        [(1, 0, 1.0, "cup", "1 cup, sliced", 115.0), (1, 1, 1.0, "cup", "1 cup, chopped", 160.0), (1, 2, 0.5, None, "onion", 55.0)],
        "food int, place int, amount double, unit string, label string, grams double",
    )
    got = {r["line"]: r["grams"] for r in nutrition.grams(lines, portions).collect()}
    assert got[1] == 320.0 and got[2] == 110.0 and got[3] is None and got[5] is None and round(got[6], 4) == 85.0485
    assert 0 < got[4] < 1


def test_inbox_steps_in_order(spark):
    names = ["fetching", "ready", "extracting", "ready", "saved", "queued"]
    steps = spark.createDataFrame([(1, n, s) for n, s in enumerate(names)] + [(2, 0, "saved")], "id int, at int, state string")
    assert {(r["id"], r["state"], r["refused"]) for r in history.replayed_states(steps, "id", "at").collect()} == {(1, "saved", 2), (2, "queued", 1)}


def test_duplicates_by_url_title_and_names(spark):
    kind = "id int, url string, title string, names array<string>"
    known = spark.createDataFrame([(1, "u1", "red lentil soup", ["lentil", "onion"]), (2, None, "green lentil soups", ["lentil", "onion"]), (3, None, "plum cake", ["plum"])], kind)
    draft = spark.createDataFrame([(9, "u1", "red lentils soup", ["lentil", "onion"])], kind)
    got = {r["id"]: r["reason"] for r in matching.duplicates(draft, known).collect()}
    assert got == {1: "same URL", 2: "similar title, 100% same ingredients"}


def test_line_recall(spark):
    truth = spark.createDataFrame([(1, "two red onions"), (1, "salt"), (2, "rice")], "key int, line string")
    found = spark.createDataFrame([(1, "two red onion"), (1, "pepper"), (3, "rice")], "key int, line string")
    assert {(r["key"], r["n"], r["hit"]) for r in matching.line_recall(truth, found, "key").collect()} == {(1, 2, 1), (2, 1, 0)}


def test_pages_and_archives(spark, tmp_path):
    import zipfile

    from galley.sources import pages

    page = (
        "<html lang=EN><head><title>Pie &amp;amp; more</title><meta content='Site' property='og:site_name'></head><div itemscope itemtype='https://schema.org/Recipe'>"
        "<h1 itemprop=name>Plum <b>pie</b></h1><meta itemprop=prepTime content=PT5M><img itemprop=image src=a.png></div><p itemprop=name>other</p>"
    )
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in pages.microdata_rows(df).select("property", "value").collect()] == [("name", "Plum pie"), ("prepTime", "PT5M"), ("image", "a.png")]
    row = pages.page_metadata(df).filter("page_id = 1").first()
    assert (row["title"], row["lang"], row["site"], row["image"]) == ("Pie & more", "en", "Site", None)
    assert pages.clipboard_text("<ul><li>one<li>two &amp; three</ul><script>x</script><p>end</p>") == "- one\n- two & three\nend"
    for n in (1, 2):
        with zipfile.ZipFile(tmp_path / f"a{n}.zip", "w") as archive:
            archive.writestr("in/food.csv", f'id,name,kcal\n{n},"a, b",1.5\n{n + 10},c,\n')
    got = documents.zipped_csv(spark, str(tmp_path), "food.csv", "id int, name string, kcal double, gone string")
    assert sorted(map(tuple, got.collect())) == [(1, "a, b", 1.5, None), (2, "a, b", 1.5, None), (11, "c", None, None), (12, "c", None, None)]


def test_empty_list_keeps_nothing(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    assert history.not_listed(rows, "k", []).count() == 0 and [r["k"] for r in history.not_listed(rows, "k", [1]).collect()] == [2]


@pytest.mark.parametrize(
    "value, want",
    [
        (None, None),
        ("Stir. Wait.", ["Stir. Wait."]),
        ("Stir it all well. Wait a while. Serve", ["Stir it all well.", "Wait a while. Serve"]),
        ("Stir well, then rest 2. 3) Serve it", ["Stir well, then rest", "2. 3) Serve it"]),
        ("a" * 45, ["a" * 20, "a" * 20, "a" * 5]),
        ("Go. " + "one two three four five six seven", ["Go. one two three", "four five six seven"]),
        ("ab " + "c" * 30, ["ab " + "c" * 17, "c" * 13]),
    ],
)
def test_bounded_parts(value, want, spark):
    from galley.functions import text

    got = spark.createDataFrame([(value,)], "v string").select(text.bounded_parts(F.col("v"), 20).alias("r")).first()["r"]
    assert got == want


def test_extraction_verdict(spark):
    rows = [(8, 8, 8, 8, 0.0), (8, 8, 9, 10, 0.0), (8, 8, 10, 8, 1.0), (8, 8, 8, 11, 0.95), (8, 8, 8, 11, 0.5), (0, 2, 0, 3, 0.0)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, f double")
    exact, tolerant = matching.extraction_verdict((F.col("a"), F.col("b")), (F.col("c"), F.col("d")), F.col("f"))
    got = [tuple(r) for r in df.select(exact.alias("e"), tolerant.alias("t")).collect()]
    assert got == [(True, True), (False, True), (False, False), (False, True), (False, False), (False, True)]


@pytest.mark.parametrize("most", [12, 60, 2000])
def test_nearest_one_to_one_is_the_greedy_matching_of_all_pairs(spark, most, monkeypatch):
    """Values that repeat and lie at equal distances, in chains that wait for others; no list of pairs is made."""
    rng = random.Random(most)
    draw = lambda n, first: [(first + 3 * k % n, rng.randrange(2), float(rng.randrange(-most, most))) for k in range(n)]
    left, right = draw(151, 5), draw(80, 1000)
    want, used = set(), set()
    for apart, a, b in sorted((abs(x[2] - y[2]), x[0], y[0]) for x in left for y in right if x[1] == y[1]):
        if apart < 9 and a not in used and b not in used:
            want.add((a, b, -apart))
            used |= {a, b}
    monkeypatch.setattr(matching, "one_to_one", None)
    odd = [(1, None, 0.0), (2, 0, None), (3, 1, float("nan"))]
    frames = [spark.createDataFrame(rows + odd, f"{n} long, g int, v double") for rows, n in ((left, "a"), (right, "b"))]
    got = [tuple(r) for r in matching.nearest_one_to_one(*frames, "g", "v", 9).select("a", "b", "score").collect()]
    assert len(got) == len(want) and set(got) == want
