"""Queries for the rest of the survey's operators: plain relational ones, nutrition, pairings, matching, histories and audits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.functions import amounts, durations, labels, text
from galley.operators import aggregates, edits, extraction, history, matching, moves, nutrition, pairings, ranking, rules, search
from galley.plans.catalog_queries import query
from galley.sources import documents as nested
from galley.sources import pages as web
from galley.sources import report
from galley.sources.tables import materialise, publish, published, shared_dir, spread, table


@query("SELECT e.vec_id, d.lang, round(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS size FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.text IS NOT NULL")
def live_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of documents that have a text."""
    live = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("vec_id"), "lang")
    vector = F.col("embedding")
    return table(spark, sf_dir, "embeddings").join(live, "vec_id").select("vec_id", "lang", F.round(search.dot(vector, vector), 5).alias("size"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))))), 6) AS total FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = pairings.unit_vector(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""SELECT t.event_id, s.event_id AS device FROM events t JOIN (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY 1) s USING (user_id)
WHERE t.event_type = 'click' AND t.ts <= TIMESTAMP '2024-01-20'""")
def due_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due timers (clicks) with the device (last signup) that they go to."""
    events = table(spark, sf_dir, "events")
    ends = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double") + F.date_part(F.lit("SECOND"), F.col("ts")).cast("double") % 1
    timers = events.filter("event_type = 'click'").select("user_id", "event_id", ends.alias("ends_at"), F.lit(None).cast("double").alias("sent_at"))
    devices = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("device"))
    return history.due_timers(timers, 1705708800.0).join(devices, "user_id").select("event_id", "device")


_FOOD_SQL = """
WITH p AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS title, regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+') AS a, regexp_extract_all(lower(p_type), '[a-z0-9]+') AS b, p_size AS k FROM part),
e AS (SELECT id, title, k, len(a) + len(b) AS size, 5.0 * len(list_filter(a, lambda x: x = 'blue')) + 0.5 * len(list_filter(b, lambda x: x = 'blue')) AS t0,
  5.0 * len(list_filter(a, lambda x: x = 'small')) + 0.5 * len(list_filter(b, lambda x: x = 'small')) AS t1 FROM p),
s AS (SELECT count(*)::DOUBLE AS n, avg(size) AS mean, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1 FROM e),
f AS (SELECT id, title, k AS extra, (t0 > 0)::INT + (t1 > 0)::INT AS found, round((-(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * size / mean))
  + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * size / mean))))::DOUBLE, 9) AS bm FROM e, s),
r AS (SELECT *, row_number() OVER (PARTITION BY found ORDER BY bm, id) AS k FROM f WHERE found > 0),
g AS (SELECT id, 2 - found AS tier, round((bm + 0.04 * length(title) - CASE WHEN contains(lower(title), 'blue') OR contains(lower(title), 'small') OR starts_with(lower(title), 'smal') THEN 1.5 ELSE 0 END
  + CASE WHEN extra % 9 = 0 THEN 4 ELSE 0 END - CASE WHEN extra % 2 = 0 THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS score FROM r WHERE k <= 200)
SELECT id, tier, score, row_number() OVER (ORDER BY tier, score, id) AS place FROM g QUALIFY place <= 12"""


@query(_FOOD_SQL)
def food_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve parts with both words, then with one; the limits are the feature."""
    docs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("title"), F.col("p_type").alias("kind"),
        F.when(F.col("p_size") % 9 == 0, "Fast Foods").alias("category"), (F.col("p_size") % 2 == 0).alias("with_portions"),
    )
    return search.all_then_any(docs, ["blue", "small"], {"title": 5.0, "kind": 0.5}, "title", limit=12)


@query("""
WITH a AS (SELECT p_name, min(p_partkey) AS food FROM part WHERE p_size % 5 <> 0 GROUP BY 1),
n AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 2 AND split_part(p_name, ' ', 1) IN ('small', 'large') THEN 4 ELSE p_partkey % 5 END AS form FROM part)
SELECT p_partkey, CASE WHEN form = 4 THEN NULL ELSE food END AS food, CASE WHEN form = 4 OR food IS NULL THEN NULL WHEN form IN (0, 3) THEN 'exact' WHEN form = 1 THEN 'any order' ELSE 'plain' END AS tier FROM n LEFT JOIN a USING (p_name)""")
def alias_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as they are, turned round, with words that change nothing, with labels, and with a word that does.

    Sizes are words that change nothing as well, so a name that begins with one is not found behind such words.
    """
    part = table(spark, sf_dir, "part")
    first, noun = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    form = F.col("p_partkey") % 5
    said = (
        F.when(form == 0, F.concat(F.upper("p_name"), F.lit("s (raw)"))).when(form == 1, F.concat(noun, F.lit(" "), first)).when(form == 2, F.concat(noun, F.lit(" fresh, ripe "), first))
        .when(form == 3, F.concat(F.lit("Gluten-free organic "), "p_name")).otherwise(F.concat(F.lit("golden "), "p_name"))
    )
    names = part.select("p_partkey", said.alias("name"))
    aliases = part.filter("p_size % 5 <> 0").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("food"))
    return search.alias_lookup(names, aliases).select("p_partkey", "food", "tier")


@query("SELECT d.lang, coalesce(l.quality::VARCHAR, 'none') AS state, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL GROUP BY 1, 2")
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the live documents are, by language."""
    state = F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("state")
    live = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "lang")
    return live.join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("lang", state).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, c_name, s_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""")
def latest_cooked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest orders with their customer and, where there is one, the supplier of the number."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("c_custkey"))
    named = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    with_supplier = named.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name"), "c_custkey", "left")
    return with_supplier.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10).select("o_orderkey", "c_name", "s_name")


@query("""SELECT o_orderkey, NOT (o_custkey % 5 IS NOT DISTINCT FROM n AND o_orderpriority IS NOT DISTINCT FROM p) AS stale FROM orders LEFT JOIN
(SELECT l_orderkey, count(*) AS n, CASE WHEN min(l_linenumber) = 1 THEN '1-URGENT' ELSE '2-HIGH' END AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('O', 'F')""")
def stale_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals (orders) against the version and text (number and first of lines) they were made for."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "review").otherwise("applied")
    made = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("base_version"), F.col("o_orderpriority").alias("before"), status.alias("status"))
    words = F.when(F.min("l_linenumber") == 1, "1-URGENT").otherwise("2-HIGH")
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("version"), words.alias("text"))
    return history.stale_proposals(made, items, "o_orderkey").select("o_orderkey", "stale")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS favourite FROM customer")
def favourite_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a customer has an open order."""
    has = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    got = table(spark, sf_dir, "customer").select("c_custkey").join(has, "c_custkey", "left")
    return got.select("c_custkey", F.coalesce("has", F.lit(False)).alias("favourite"))


@query("""WITH l AS (SELECT l_orderkey, l_quantity * CASE WHEN l_returnflag = 'N' THEN 30 ELSE 1 END AS g, l_linestatus = 'O' AS sure, CASE WHEN l_linenumber = 7 THEN 'no FDC match' WHEN l_linenumber = 6 THEN 'to taste' END AS reason,
p_size::DOUBLE AS kcal, (p_partkey % 10)::DOUBLE AS fat, CASE WHEN l_orderkey % 3 = 0 THEN 2.0 WHEN l_orderkey % 3 = 1 THEN 6.0 ELSE 4.0 END AS servings FROM lineitem JOIN part ON p_partkey = l_partkey),
t AS (SELECT l_orderkey, servings, sum(CASE WHEN reason IS NULL THEN kcal * g / 100 ELSE 0 END) AS kcal, sum(CASE WHEN reason IS NULL THEN fat * g / 100 ELSE 0 END) AS fat,
sum(CASE WHEN reason IS NULL OR reason = 'no FDC match' THEN g ELSE 0 END) AS mass, sum(CASE WHEN reason IS NULL AND sure THEN g ELSE 0 END) AS matched FROM l GROUP BY 1, 2)
SELECT l_orderkey, round(kcal / servings, 4) AS kcal_g, round(fat / servings, 4) AS fat_g, round(100 * matched / nullif(mass, 0), 1) AS matched_pct,
CASE WHEN round(100 * matched / nullif(mass, 0), 1) >= 90 THEN 'high' WHEN round(100 * matched / nullif(mass, 0), 1) >= 70 THEN 'medium' ELSE 'low' END AS badge FROM t""")
def nutrition_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recipes, parts as foods; servings from a number, from the yield text or assumed."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("kcal_g"), (F.col("p_partkey") % 10).cast("double").alias("fat_g"))
    lines = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    grams = F.col("l_quantity") * F.when(F.col("l_returnflag") == "N", 30.0).otherwise(1.0)
    given = F.when(F.col("l_orderkey") % 3 == 0, 2)
    said = F.when(F.col("l_orderkey") % 3 == 1, "Makes 6 bowls").otherwise("Makes a 900 g loaf")
    reason = F.when(F.col("l_linenumber") == 7, "no FDC match").when(F.col("l_linenumber") == 6, "to taste")
    ready = lines.select(
        "l_orderkey", nutrition.servings(given, said)["servings"].alias("servings"), F.when(reason.isNull(), grams).alias("grams"), grams.alias("approx"), reason.alias("reason"),
        (F.col("l_linestatus") == "O").alias("sure"), "kcal_g", "fat_g",
    )
    return nutrition.totals(ready, "l_orderkey", "servings", ["kcal_g", "fat_g"], places=4)


_PIECE = "CASE WHEN p_partkey % 3 <> 1 THEN (80 + p_size) / 2.0 ELSE 30.0 END"
_CUP = "(CASE WHEN user_id % 2 = 0 THEN 150 ELSE 100 END + p_size)"


@query(f"""WITH l AS (SELECT event_id, event_type AS t, round(value / 10, 1) AS q, user_id, p_partkey, p_size FROM events LEFT JOIN part ON p_partkey = user_id)
SELECT event_id, round(CASE WHEN q <= 0 THEN NULL WHEN t = 'view' THEN q * 28.3495 WHEN t = 'click' THEN q * {_CUP} WHEN t = 'signup' THEN q * 29.5735 * {_CUP} / 236.588
WHEN t = 'purchase' THEN CASE WHEN p_partkey % 3 <> 1 THEN q * {_PIECE} END ELSE q * {_PIECE} END, 6) AS grams,
CASE WHEN q <= 0 THEN NULL WHEN t = 'view' THEN 'mass' WHEN p_partkey IS NULL THEN NULL WHEN t IN ('click', 'signup') THEN 'volume portion' WHEN t = 'purchase' AND p_partkey % 3 = 1 THEN NULL ELSE 'count portion' END AS method FROM l""")
def line_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as lines with an amount, parts as foods with portions by volume, by piece and by serving.

    A part without a large piece weighs by the piece that is named after it; a large one of it is not guessed.
    """
    unit = amounts.lookup({"click": "Cups", "view": "oz", "purchase": "lg", "signup": "fluid oz"}, F.col("event_type"))
    part = table(spark, sf_dir, "part")
    noun = F.element_at(F.split("p_name", " "), -1)
    lines = table(spark, sf_dir, "events").join(part.select(F.col("p_partkey").alias("user_id"), noun.alias("noun")), "user_id", "left").select(
        F.col("event_id").alias("line"), F.col("user_id").alias("food"), F.round(F.col("value") / 10, 1).alias("quantity"), unit.alias("unit"),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("chopped "), "noun", F.lit("s"))).otherwise("two eggs").alias("text"),
    )
    size = F.col("p_size").cast("double")
    portion = lambda amount, unit, label, grams: F.struct(
        F.lit(amount).alias("amount"), F.lit(unit).cast("string").alias("unit"), label.alias("label"), grams.alias("grams")
    )
    every = F.array(
        portion(1.0, "cup", F.lit("1 cup"), 100 + size),
        portion(1.0, "cup", F.concat(F.lit("1 cup, chopped "), noun), 150 + size),
        portion(2.0, None, F.when(F.col("p_partkey") % 3 != 1, "large (2 in dia)").otherwise("serving, large"), 80 + size),
        portion(0.5, None, noun, F.lit(30.0)),
        portion(1.0, None, F.lit("large serving"), F.lit(999.0)),
    )
    portions = part.select(F.col("p_partkey").alias("food"), F.col("p_name").alias("described"), F.posexplode(every).alias("place", "p")).select("food", "described", "place", "p.*")
    return nutrition.grams(lines, portions).select(F.col("line").alias("event_id"), F.round("grams", 6).alias("grams"), "method")


@query("""
WITH l AS (SELECT l_orderkey AS recipe, l_orderkey * 100 + l_linenumber AS line, l_partkey, l_quantity AS q, l_linenumber % 4 AS form, CASE l_suppkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'close' WHEN 2 THEN 'approximate' END AS quality,
  l_linenumber = 5 AND l_linestatus = 'F' AS unread, CASE WHEN l_discount = 0.1 THEN 'to taste' END AS left_out, CASE WHEN l_tax < 0.02 THEN l_partkey END AS alias, l_suppkey % 5 = 0 AS byhand,
  CASE WHEN l_suppkey % 10 = 0 THEN l_partkey END AS own_food, CASE WHEN l_suppkey % 20 = 0 THEN 77.0 END AS own_grams, p_size, p_partkey % 3 AS m FROM lineitem JOIN part ON p_partkey = l_partkey
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_suppkey) = 1),
f AS (SELECT *, byhand AND own_food IS NOT NULL AS hand, CASE WHEN byhand AND own_food IS NULL THEN 'excluded by user' WHEN unread AND NOT (byhand AND own_food IS NOT NULL) THEN 'could not parse' WHEN NOT byhand THEN left_out END AS gone FROM l),
g AS (SELECT *, CASE WHEN gone IS NULL THEN coalesce(own_food, alias, CASE WHEN quality IS NOT NULL THEN l_partkey END) END AS food,
  CASE WHEN unread THEN NULL WHEN form = 0 THEN q * 28.3495 WHEN form = 1 THEN q * (100 + p_size) WHEN form = 2 AND m <> 1 THEN q * (80 + p_size) / 2.0 END AS portion FROM f),
w AS (SELECT *, CASE WHEN food IS NULL THEN NULL WHEN hand AND own_grams > 0 THEN own_grams WHEN portion IS NOT NULL THEN portion WHEN NOT unread AND form = 3 THEN 55.0 END AS grams FROM g)
SELECT recipe, line, food, CASE WHEN food IS NULL THEN NULL WHEN hand THEN 'user override' WHEN alias IS NOT NULL THEN 'alias' ELSE 'model pick (' || quality || ')' END AS match, round(grams, 6) AS grams,
  CASE WHEN grams IS NOT NULL THEN ['low', 'medium', 'high'][1 + least(CASE WHEN hand OR alias IS NOT NULL OR quality = 'exact' THEN 2 WHEN quality = 'close' THEN 1 ELSE 0 END,
    CASE WHEN hand AND own_grams > 0 THEN 2 WHEN form = 3 THEN 0 WHEN form = 2 THEN 1 ELSE 2 END)] END AS confidence,
  coalesce(gone, CASE WHEN food IS NULL THEN 'no FDC match' WHEN grams IS NULL THEN 'no amount that converts to grams' END) AS reason, byhand AS overridden FROM w""")
def recipe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders with curated names, a model's picks and what people have set, weighed by the parts' portions."""
    part = table(spark, sf_dir, "part")
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey").withColumn("n", F.row_number().over(first)).filter("n = 1")
    key = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line")
    form, by = F.col("l_linenumber") % 4, F.col("l_suppkey")
    quality = F.when(by % 4 == 0, "exact").when(by % 4 == 1, "close").when(by % 4 == 2, "approximate")
    rows = lines.select(
        F.col("l_orderkey").alias("recipe"), key, F.lit("a line").alias("text"), F.col("l_quantity").alias("quantity"),
        F.when(form == 0, "ounces").when(form == 1, "c").when(form == 3, "handful").alias("unit"), F.when(form == 3, 55.0).alias("approx"),
        ((F.col("l_linenumber") == 5) & (F.col("l_linestatus") == "F")).alias("unread"), F.when(F.col("l_discount") == 0.1, "to taste").alias("left_out"),
        F.when(F.col("l_tax") < 0.02, F.col("l_partkey")).alias("alias"), F.when(quality.isNotNull(), F.col("l_partkey")).alias("pick"), quality.alias("quality"),
    )
    overrides = lines.filter("l_suppkey % 5 = 0").select(key, F.when(by % 10 == 0, F.col("l_partkey")).alias("food"), F.when(by % 20 == 0, 77.0).alias("grams"))
    size = F.col("p_size").cast("double")
    every = F.array(
        F.struct(F.lit(1.0).alias("amount"), F.lit("cup").alias("unit"), F.lit("1 cup").alias("label"), (100 + size).alias("grams")),
        F.struct(F.lit(2.0).alias("amount"), F.lit(None).cast("string").alias("unit"), F.when(F.col("p_partkey") % 3 != 1, "medium").otherwise("sliver").alias("label"), (80 + size).alias("grams")),
    )
    portions = part.select(F.col("p_partkey").alias("food"), F.posexplode(every).alias("place", "p")).select("food", "place", "p.*")
    got = nutrition.computed_lines(rows, portions, part.select(F.col("p_partkey").alias("food"), F.col("p_name").alias("described")), overrides)
    return got.select("recipe", "line", "food", "match", F.round("grams", 6).alias("grams"), "confidence", "reason", "overridden")


@query("""
WITH c AS (SELECT l_orderkey, round(sum(l_quantity * 3) / 4, 0) AS kcal, round(sum(l_linenumber) / 3, 1) AS protein_g FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round(round(o_totalprice / 100, 2), 1) WHEN 1 THEN round(round(o_totalprice / 100, 2) / 4.184, 1) WHEN 2 THEN 0.0 END AS kcal, round((o_orderkey % 900) / 1000.0, 1) AS protein FROM orders)
SELECT l_orderkey, CASE WHEN p.kcal > 0 THEN 'publisher' ELSE 'computed' END AS source, CASE WHEN p.kcal > 0 THEN round(p.kcal, 0) ELSE c.kcal END AS kcal, CASE WHEN p.kcal > 0 THEN p.protein ELSE protein_g END AS protein_g,
  CASE WHEN NOT coalesce(p.kcal > 0, false) THEN 'high' END AS badge, c.kcal AS computed_kcal FROM c JOIN p ON o_orderkey = l_orderkey""")
def publisher_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page says of an order, in kilocalories or kilojoules and milligrams, stands before what its lines come to."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    computed = lines.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * 3) / 4, 0).alias("kcal"), F.round(F.sum("l_linenumber") / 3, 1).alias("protein_g"))
    key, price = F.col("o_orderkey") % 4, (F.round(F.col("o_totalprice") / 100 * 100) / 100).cast("decimal(18,2)").cast("string")
    energy = F.when(key == 0, F.concat(price, F.lit(" kcal"))).when(key == 1, F.concat(price, F.lit("kJ"))).when(key == 2, "0 kcal").otherwise("unknown")
    protein = F.concat((F.col("o_orderkey") % 900).cast("string"), F.lit(" mg"))
    page = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), nutrition.publisher_value(energy, "kcal").alias("kcal"), nutrition.publisher_value(protein, "g").alias("protein_g")
    )
    got = nutrition.with_publisher(computed.withColumn("badge", F.lit("high")), page, "l_orderkey", ["kcal", "protein_g"])
    return got.select("l_orderkey", "source", "kcal", "protein_g", "badge", "computed_kcal")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1000 + event_id % 100 WHEN 1 THEN round(value / 4.184, 6) WHEN 2 THEN 12.5 ELSE NULL END::DOUBLE AS kcal,
CASE event_id % 4 WHEN 2 THEN 0.0125 WHEN 3 THEN NULL WHEN 0 THEN 1000 + event_id % 100 ELSE round(value, 2) END::DOUBLE AS fat FROM events""")
def publisher_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """thousands, kilojoules, decimal commas in milligrams, and no number at all."""
    e = F.col("event_id")
    said = (
        F.when(e % 4 == 0, F.concat(F.lit("1,"), F.lpad((e % 100).cast("string"), 3, "0"), F.lit(" kcal")))
        .when(e % 4 == 1, F.concat(F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" kJ")))
        .when(e % 4 == 2, "12,5 mg").otherwise("none")
    )
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(nutrition.publisher_value(said, "kcal"), 6).alias("kcal"), nutrition.publisher_value(said, "g").alias("fat")
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN (p_size + (p_size + 2)) / 2.0 ELSE p_size END::DOUBLE AS mean, CASE WHEN p_size % 3 = 0 THEN p_size + 2 END::DOUBLE AS high, 'cups' AS unit,
CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 = 0 THEN p_size + 1 ELSE p_size END ELSE 9 END::DOUBLE AS trusted, 'us' AS system FROM part""")
def amount_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the same lines as nutrition, a client and a model read them."""
    size = F.col("p_size").cast("string")
    line = F.concat(size, F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("-"), (F.col("p_size") + 2).cast("string"))).otherwise(""), F.lit(" cups "), F.col("p_name"))
    mean, parts = amounts.mean_amount(line), amounts.split_line(line)
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", "p_size", mean.alias("m"), parts.alias("s"))
    given = F.when(F.col("p_size") % 2 == 0, "cup").otherwise("g")
    trusted = nutrition.reconciled(F.lit(9.0), given, F.col("m.quantity"), F.col("m.word"))
    return rows.select(
        "p_partkey", F.col("m.quantity").alias("mean"), "s.high", "s.unit", trusted.alias("trusted"), amounts.unit_system(F.col("s.unit")).alias("system")
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN (p_size // 4)::VARCHAR ELSE CASE WHEN p_size < 4 THEN '' ELSE (p_size // 4)::VARCHAR END || ['¼', '½', '¾'][p_size % 4] END AS shown,
CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE CASE WHEN p_size < 2 THEN '' ELSE (p_size // 2)::VARCHAR END || '½' END AS doubled,
(p_size / gcd(p_size, 4))::BIGINT AS n, (4 / gcd(p_size, 4))::BIGINT AS d,
CASE WHEN p_size >= 40 THEN round(p_size / 4)::INT::VARCHAR WHEN p_size % 4 = 0 THEN (p_size // 4)::VARCHAR ELSE CASE WHEN p_size < 4 THEN '' ELSE (p_size // 4)::VARCHAR END || ['¼', '½', '¾'][p_size % 4] END AS client FROM part""")
def fraction_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of the sizes of parts as fractions, doubled, and as a client shows them."""
    value = F.col("p_size") / 4
    written = F.concat(F.col("p_size").cast("string"), F.lit("/4"))
    exact = amounts.exact(written)
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(
        "p_partkey", amounts.nice(value).alias("shown"), amounts.scaled(written, 2.0).alias("doubled"), exact["n"].alias("n"), exact["d"].alias("d"),
        amounts.client_fraction(value).alias("client"),
    )


@query("""SELECT p_partkey, 'Bake at ' || (round((p_size * 5 + 200 - 32) * 5 / 9 / 5) * 5)::INT || '°C' AS metric, (p_size * 50) || ' g ' || p_name AS line,
CASE WHEN p_size * 50 / 28.35 >= 16 THEN 'lb' ELSE 'oz' END AS unit FROM part""")
def converted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperatures and weights in the other system; a factor of one changes nothing."""
    hot = F.concat(F.lit("Bake at "), (F.col("p_size") * 5 + 200).cast("string"), F.lit("°F"))
    line = F.concat((F.col("p_size") * 50).cast("string"), F.lit(" g "), F.col("p_name"))
    us = F.element_at(F.split(amounts.converted(line, "us"), " "), -3)
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", amounts.temperatures(hot, "metric").alias("metric"), amounts.scaled_line(line, 1.0).alias("line"), us.alias("unit"))


@query("""SELECT a.conv_id, a.turn, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE round(len(list_intersect(a.w, b.w)) / len(a.w), 9) END AS share,
CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN false ELSE len(list_intersect(a.w, b.w)) / len(a.w) >= 0.55 END AS enough FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations) a
JOIN (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations) b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def turn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of the words of each turn the next turn has as well, and whether it is enough."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("w"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("next"))
    share = text.overlap(F.col("w"), F.col("next"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(share, 9).alias("share"), (share >= 0.55).alias("enough"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60 most common words of all documents; the limit is the feature."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(60)


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), 'idiot|scum|licen[cs]e|copyright|trash')))::INT AS hits FROM documents WHERE text IS NOT NULL")
def marker_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different markers each document has."""
    hits = pairings.distinct_hits(F.lower("text"), "idiot|scum|licen[cs]e|copyright|trash")
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", hits.alias("hits"))


@query("SELECT c_custkey, count(o_orderkey)::INT AS items, count(DISTINCT o_orderstatus)::INT AS sections FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def nested_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders nested by status under their customer, as a map, and counted from it."""
    inner = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderstatus").agg(F.collect_list("o_orderkey").alias("items"))
    nested = inner.groupBy("c_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "items"))).alias("sections"))
    held = table(spark, sf_dir, "customer").select("c_custkey").join(nested, "c_custkey", "left")
    sizes = F.aggregate(F.transform(F.map_values("sections"), lambda s: F.size(s)), F.lit(0), lambda a, x: a + x)
    return held.select("c_custkey", F.coalesce(sizes, F.lit(0)).alias("items"), F.coalesce(F.size(F.map_keys("sections")), F.lit(0)).alias("sections"))


@query("SELECT w AS word FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS w FROM part UNION SELECT unnest(['salt', 'water', 'oil'])) WHERE w NOT IN ('old', 'new', 'water')")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of parts and a base vocabulary, without generic ones."""
    used = table(spark, sf_dir, "part").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), 0)).alias("word"))
    base = spark.createDataFrame([("salt",), ("water",), ("oil",)], "word string")
    generic = spark.createDataFrame([("old",), ("new",), ("water",)], "word string")
    return used.union(base).distinct().join(generic, "word", "left_anti")


@query("""SELECT c_mktsegment, arg_min(c_nationkey, n * 100 + c_nationkey) AS colour FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1""")
def least_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation with the fewest customers of each segment, the first of equal ones."""
    used = table(spark, sf_dir, "customer").groupBy("c_mktsegment", F.col("c_nationkey").alias("colour")).agg(F.count("*").alias("n"))
    return aggregates.first_best(used, ["c_mktsegment"], -F.col("n"), [F.col("colour")]).drop("n")


@query("""SELECT p_partkey, p_retailprice FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30) WHERE p_type <> 'PROMO' ORDER BY p_retailprice DESC, p_partkey LIMIT 8""")
def overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: eight of the thirty dearest parts that are no promotion; both limits are the feature."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_type")
    return ranking.overfetched(rows, [F.desc("p_retailprice"), F.col("p_partkey")], F.col("p_type") != "PROMO", 8).drop("p_type")


@query("""SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3 ELSE 4 END AS section,
row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3 ELSE 4 END, lower(p_name), p_partkey) AS place FROM part""")
def listed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand by section in a given order, then by title regardless of case and punctuation."""
    rows = table(spark, sf_dir, "part").withColumn("section", ranking.in_listed_order(F.col("p_type"), ["SMALL", "MEDIUM", "LARGE"]))
    shouted = F.concat(F.lit("\"'"), F.initcap("p_name"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("section", ranking.title_order(shouted), F.lower("p_name"), "p_partkey"))
    return rows.select("p_partkey", "section", place.alias("place"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'N') DESC, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem QUALIFY place <= 8""")
def convertible_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order at most eight lines, those that convert first."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return ranking.first_tiers(rows, ["l_orderkey"], F.col("l_returnflag") == "N", order, 8).drop("l_suppkey", "l_returnflag")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value >= 20 AND user_id IS NOT NULL AND event_type NOT IN ('view', 'signup')")
def dynamic_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conditions that are given, one after another; a list to leave out, which is not empty here."""
    rows = table(spark, sf_dir, "events")
    given = {"event_type": "click", "user_id": None, "least": 20}
    if given["event_type"]:
        rows = rows.filter(F.col("event_type") == given["event_type"])
    if given["user_id"]:
        rows = rows.filter(F.col("user_id") == given["user_id"])
    if given["least"] is not None:
        rows = rows.filter(F.col("value") >= given["least"])
    return history.not_listed(rows.filter("user_id is not null"), "event_type", ["view", "signup"]).select("event_id")


@query("SELECT event_type AS queue, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE value < 50 GROUP BY 1")
def claimed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest queued job of each queue."""
    status = F.when(F.col("value") < 50, "queued").otherwise("done").alias("status")
    jobs = table(spark, sf_dir, "events").select(F.col("event_type").alias("queue"), "event_id", "ts", status)
    return ranking.claimed(jobs, "queue", [F.col("ts"), F.col("event_id")]).select("queue", "event_id")


@query("""SELECT conv_id, turn, text AS "window" FROM conversations WHERE text IS NOT NULL UNION ALL SELECT a.conv_id, a.turn, a.text || ' ' || b.text FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
WHERE a.text IS NOT NULL AND b.text IS NOT NULL""")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn, and each turn with the next."""
    return ranking.line_windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text")


@query("""SELECT o_orderkey, (o_custkey % 5) IS DISTINCT FROM n AS conflict FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def edit_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: edits that expect another version than there is."""
    edits = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("expected_version"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("version"))
    return history.checked_edits(edits, items, "o_orderkey").select("o_orderkey", "conflict")


@query("""WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, value AS state FROM events)
SELECT user_id, version, state FROM r UNION ALL SELECT user_id, m + 1, state FROM r JOIN (SELECT user_id, max(version) AS m FROM r GROUP BY 1) USING (user_id) WHERE version = 2""")
def restored_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: events of a user as revisions, the second one restored."""
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    revisions = table(spark, sf_dir, "events").select("user_id", version.alias("version"), F.col("value").alias("state"))
    return history.restored(revisions, "user_id", F.lit(2))


@query("""WITH j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' ELSE 'done' END AS status FROM orders)
SELECT id, CASE status WHEN 'running' THEN 'queued' ELSE status END AS status FROM j UNION ALL SELECT o_orderkey, 'queued' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey NOT IN (SELECT id FROM j WHERE status <> 'done')""")
def recovered_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after a restart; every order has one, urgent ones need one that is not done."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("done")
    jobs = orders.select(F.col("o_orderkey").alias("id"), status.alias("status"))
    return history.recovered(jobs, orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id")), "id")


@query("SELECT user_id, event_id FROM events WHERE event_type = 'signup' OR (event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup'))")
def replaced_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: signups replace all views of their user."""
    of = lambda kind: table(spark, sf_dir, "events").filter(F.col("event_type") == kind).select("user_id", "event_id")
    return history.replaced_sets(of("view"), of("signup"), "user_id")


@query()
def inbox_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the steps of an inbox entry."""
    names = {"click": "fetching", "view": "extracting", "purchase": "ready", "signup": "saved", "error": "failed"}
    steps = table(spark, sf_dir, "events").select("user_id", "event_id", amounts.lookup(names, F.col("event_type")).alias("state"))
    return history.replayed_states(steps, "user_id", "event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'view' OR 1705708800 - epoch(ts) <= 864000")
def purged_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timers (views are sent ones) without those sent long ago."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    timers = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", at).alias("sent_at"))
    return history.purged(timers, 1705708800.0, 864_000.0).select("event_id")


_GUARDS = ("customer", "orders", "events", "labels")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t} HAVING count(*) > 0" for t in _GUARDS))
def user_data_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: the tables that hold data of users, with how many rows."""
    counts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _GUARDS]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.filter("n > 0")


_REGIONS = [("SMALL", "north", 1.0), ("LARGE", "south", 1.0), ("MEDIUM", "north", 0.6), ("MEDIUM", "south", 0.75)]
_LINKS = [("north", "south", 0.6), ("south", "north", 0.6)]
_KNOWN = "k AS (SELECT * FROM (VALUES ('SMALL', 'north', 1.0), ('LARGE', 'south', 1.0), ('MEDIUM', 'north', 0.6), ('MEDIUM', 'south', 0.75)) t(tag, region, weight))"


@query(f"""WITH {_KNOWN}, t AS (SELECT p_partkey AS id, region, weight FROM part JOIN k ON tag = p_type),
m AS (SELECT p_partkey, len(list_distinct(regexp_extract_all(lower(p_name), 'hot|red|gear|bolt'))) AS hits FROM part WHERE p_type IN ('PROMO', 'ECONOMY', 'STANDARD'))
SELECT id, region, max(weight)::DOUBLE AS weight FROM (SELECT * FROM t UNION ALL SELECT p_partkey, 'east', 1.0 FROM m WHERE hits >= 2) GROUP BY 1, 2""")
def dish_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of parts by their type, or by two markers in the name where the type says nothing."""
    part = table(spark, sf_dir, "part")
    tags = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("tag"))
    known = spark.createDataFrame(_REGIONS, "tag string, region string, weight double")
    hits = pairings.distinct_hits(F.lower("p_name"), "hot|red|gear|bolt")
    markers = part.select(F.col("p_partkey").alias("id"), F.lit("east").alias("region"), hits.alias("hits"))
    return pairings.regions(tags, known, markers, ["PROMO", "ECONOMY", "STANDARD"])


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'hot') AND (contains(p_name, 'gear') OR contains(p_name, 'bolt')) THEN 2 ELSE 1 END AS richness,
CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 1 END AS weight,
p_type IN ('SMALL', 'PROMO') AND NOT (contains(p_name, 'hot') AND (contains(p_name, 'gear') OR contains(p_name, 'bolt'))) AND p_size % 2 = 0 AND p_brand NOT LIKE '%2' AND p_partkey % 3 <> 0 AS plain,
greatest(CASE WHEN contains(p_name, 'hot') AND (contains(p_name, 'gear') OR contains(p_name, 'bolt')) AND p_size % 3 = 0 THEN 1.0 ELSE 0 END, CASE WHEN p_size % 5 = 0 THEN 0.8 ELSE 0 END, CASE WHEN p_size % 4 = 2 AND p_size % 7 = 0 THEN 0.7 ELSE 0 END)::DOUBLE AS contrast FROM part""")
def dish_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of parts by words and names, whether they are plain, and how they set off a made-up dish."""
    rich = pairings.word_level(F.col("p_name"), ["hot", "gear", "bolt"])
    weight = pairings.level(amounts.lookup({0: "light", 1: "medium", 2: "2", 3: "odd"}, F.col("p_size") % 4))
    a = lambda *x: F.array(*map(F.lit, x))
    cuisines = F.when(F.endswith("p_brand", F.lit("2")), a("Thai")).otherwise(a("American"))
    flavours = F.when(F.col("p_partkey") % 3 == 0, a("spicy")).otherwise(a("mild"))
    plain = pairings.neutral(F.array("p_type"), rich, F.col("p_size") % 2 != 0, cuisines, flavours, ["SMALL", "PROMO"], ["American", "European"])
    own = {"richness": rich, "acidity": F.lit(0), "weight": weight, "texture": F.when(F.col("p_size") % 5 == 0, a("creamy")).otherwise(a("firm"))}
    other = {"richness": F.lit(0), "acidity": F.when(F.col("p_size") % 3 == 0, 2).otherwise(0), "weight": F.when(F.col("p_size") % 7 == 0, 0).otherwise(1), "texture": a("crisp")}
    return table(spark, sf_dir, "part").select(
        "p_partkey", rich.alias("richness"), weight.alias("weight"), plain.alias("plain"), pairings.contrast(own, other).alias("contrast")
    )


_ANCHOR_SQL = f"""WITH {_KNOWN}, a AS (SELECT * FROM part WHERE p_partkey IN (1, 2, 3)),
d AS (SELECT p_partkey AS id, region, weight FROM part JOIN k ON tag = p_type),
l AS (SELECT * FROM (VALUES ('north', 'south', 0.6), ('south', 'north', 0.6), ('north', 'north', 0.85), ('south', 'south', 0.85)) t(x, y, link)),
f AS (SELECT x.id AS a, y.id AS b, max(x.weight * y.weight * link)::DOUBLE AS affinity FROM d x JOIN l ON x.region = l.x JOIN d y ON y.region = l.y WHERE x.id IN (1, 2, 3) GROUP BY 1, 2),
p AS (SELECT a.p_partkey AS anchor, c.p_partkey AS id, c.p_name AS title, CASE WHEN a.p_type = c.p_type THEN 1.0 ELSE coalesce(f.affinity, 0) END AS affinity,
a.p_type IN (SELECT tag FROM k) AS anchor_has, c.p_type IN (SELECT tag FROM k) AS has, c.p_size % 2 = 0 AS plain, c.p_size, a.p_size AS own, c.p_partkey AS k
FROM a JOIN part c ON c.p_partkey <> a.p_partkey AND c.p_size BETWEEN a.p_size - 6 AND a.p_size + 6 LEFT JOIN f ON f.a = a.p_partkey AND f.b = c.p_partkey),
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors (three parts) with the parts of about their size, and what pairing asks of a pair."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("tag"), "p_size")
    known = spark.createDataFrame(_REGIONS, "tag string, region string, weight double")
    weights = part.join(F.broadcast(known), "tag").select("id", "region", "weight")
    anchors = part.filter(F.col("id").isin(1, 2, 3))
    other = anchors.select(F.col("id").alias("anchor"), F.col("tag").alias("own"), F.col("p_size").alias("own_size"))
    near = F.col("p_size").between(F.col("own_size") - 6, F.col("own_size") + 6) & (F.col("id") != F.col("anchor"))
    pairs = part.join(F.broadcast(other), near)  # three anchors
    shared = pairs.filter("own = tag").select(F.col("anchor").alias("a"), F.col("id").alias("b"))
    links = spark.createDataFrame(_LINKS, "left string, right string, link double")
    near_by = pairings.affinity_of(weights.join(F.broadcast(anchors.select("id")), "id"), weights, links, shared)
    near_by = near_by.select(F.col("a").alias("anchor"), F.col("b").alias("id"), "affinity")
    tagged = lambda c: F.col(c).isin(sorted({t for t, _, _ in _REGIONS}))
    return pairs.join(near_by, ["anchor", "id"], "left").select(
        "anchor", "id", "title", "p_size", F.coalesce("affinity", F.lit(0.0)).alias("affinity"), tagged("own").alias("anchor_has"), tagged("tag").alias("has"),
        (F.col("p_size") % 2 == 0).alias("plain"),
    )


_WEIGHTS = ", ".join(f"('{a}', '{c}', {w})" for a, others in pairings.COMPLEMENTS.items() for c, w in others.items())


@query(_ANCHOR_SQL + f"""w AS (SELECT * FROM (VALUES {_WEIGHTS}) t(mine, course, complement) WHERE course <> 'snack'),
c AS (SELECT p.*, w.course, w.complement FROM p JOIN w ON w.mine IN (SELECT unnest(CASE anchor % 3 WHEN 0 THEN ['main'] WHEN 1 THEN ['soup', 'side'] ELSE ['salad'] END))
  AND w.course IN (SELECT unnest([CASE k % 3 WHEN 0 THEN 'side' WHEN 1 THEN 'bread' ELSE 'dessert' END, 'sauce/condiment', CASE WHEN k % 4 = 0 THEN 'soup' ELSE 'main' END]))),
o AS (SELECT *, CASE WHEN anchor_has THEN CASE WHEN affinity >= 0.55 THEN affinity WHEN plain THEN 0.5 END ELSE greatest(affinity, CASE WHEN plain OR NOT has THEN 0.5 ELSE 0.3 END) END AS compat FROM c QUALIFY row_number() OVER (PARTITION BY anchor, id ORDER BY complement DESC, course DESC) = 1),
s AS (SELECT anchor, id, title, course, round((compat * 3 + complement * 2 + CASE WHEN course = 'dessert' THEN 0 ELSE (k % 6) / 5 END * 0.8 + (k % 10) / 10 * 0.5 - CASE WHEN course IN ('side', 'salad') AND k % 4 = 0 THEN 2.5 ELSE 0 END
 + CASE WHEN k % 5 = 0 THEN 0.4 ELSE 0 END + 0.3 * greatest(-2, least(2, k % 7 - 3)))::DOUBLE, 9) AS exact FROM o WHERE compat IS NOT NULL AND NOT (k % 11 = 0 AND anchor % 3 = 0 AND course <> 'dessert')
 AND NOT (k % 13 = 0 AND course IN ('sauce/condiment', 'side', 'bread')) AND NOT (anchor % 2 = 0 AND course = 'sauce/condiment')),
u AS (SELECT *, row_number() OVER (PARTITION BY anchor, course ORDER BY exact DESC, title, id) AS n FROM s)
SELECT anchor, id, course, round(exact, 3) AS score, row_number() OVER (PARTITION BY anchor ORDER BY exact DESC, title, id) AS place FROM u WHERE n <= CASE course WHEN 'side' THEN 2 WHEN 'salad' THEN 2 ELSE 1 END QUALIFY place <= 6""")
def build_a_meal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dishes beside three anchors; the number of slots is the feature."""
    k, anchor = F.col("id"), F.col("anchor")
    mine = F.when(anchor % 3 == 0, F.array(F.lit("main"))).when(anchor % 3 == 1, F.array(F.lit("soup"), F.lit("side"))).otherwise(F.array(F.lit("salad")))
    first = F.when(k % 3 == 0, "side").when(k % 3 == 1, "bread").otherwise("dessert")
    courses = F.array(first, F.lit("sauce/condiment"), F.when(k % 4 == 0, "soup").otherwise("main"))
    pairs = _pairs(spark, sf_dir).withColumn("o", F.explode(pairings.course_options(mine, courses))).select(
        "*", "o.course", "o.complement", F.col("plain").alias("neutral"), (k % 11 == 0).alias("sweet"), (anchor % 3 == 0).alias("savory"), (k % 6 / 5).alias("contrast"),
        (k % 10 / 10).alias("similarity"), (k % 4 == 0).alias("both_meaty"), (k % 5 == 0).alias("favourite"), (k % 7 - 3).alias("votes"),
        (k % 13 == 0).alias("component"), (anchor % 2 == 0).alias("anchor_wet"),
    )
    return pairings.meals(pairs)


@query(f"""WITH {_KNOWN}, d AS (SELECT p_partkey AS id, p_name AS title, p_type AS tag, p_size // 10 AS band, p_partkey % 12 AS m, p_type IN (SELECT tag FROM k) AS has,
  round((p_partkey % 10) / 10 * 0.5 + CASE WHEN p_partkey % 5 = 0 THEN 0.4 ELSE 0 END + 0.3 * greatest(-2, least(2, p_partkey % 7 - 3)), 9)::DOUBLE AS own FROM part),
l AS (SELECT * FROM (VALUES ('north', 'south', 0.6), ('south', 'north', 0.6), ('north', 'north', 0.85), ('south', 'south', 0.85)) t(x, y, link)),
f AS (SELECT x.tag AS ta, y.tag AS tb, max(x.weight * y.weight * link)::DOUBLE AS affinity FROM k x JOIN l ON x.region = l.x JOIN k y ON y.region = l.y GROUP BY 1, 2),
w AS (SELECT * FROM (VALUES {_WEIGHTS}) t(mine, course, complement) WHERE course <> 'snack'),
a AS (SELECT DISTINCT x.id AS anchor, y.*, x.m AS am, x.has AS anchor_has, CASE WHEN x.tag = y.tag THEN 1.0 ELSE coalesce(f.affinity, 0) END AS affinity
  FROM d x JOIN d y ON x.id <> y.id AND abs(x.band - y.band) <= 1 LEFT JOIN f ON f.ta = x.tag AND f.tb = y.tag),
c AS (SELECT a.*, w.course, w.complement FROM a JOIN w ON w.mine IN (SELECT unnest(CASE am % 3 WHEN 0 THEN ['main'] WHEN 1 THEN ['soup', 'side'] ELSE ['salad'] END))
  AND w.course IN (SELECT unnest([CASE m % 3 WHEN 0 THEN 'side' WHEN 1 THEN 'bread' ELSE 'dessert' END, 'sauce/condiment', CASE WHEN m % 4 = 0 THEN 'soup' ELSE 'main' END]))),
o AS (SELECT *, m % 2 = 0 AS plain, CASE WHEN anchor_has THEN CASE WHEN affinity >= 0.55 THEN affinity WHEN m % 2 = 0 THEN 0.5 END ELSE greatest(affinity, CASE WHEN m % 2 = 0 OR NOT has THEN 0.5 ELSE 0.3 END) END AS compat FROM c QUALIFY row_number() OVER (PARTITION BY anchor, id ORDER BY complement DESC, course DESC) = 1),
s AS (SELECT anchor, id, title, course, round((compat * 3 + complement * 2 + CASE WHEN course = 'dessert' THEN 0 ELSE (m % 6) / 5 END * 0.8 - CASE WHEN course IN ('side', 'salad') AND m % 4 = 0 THEN 2.5 ELSE 0 END + own)::DOUBLE, 9) AS exact
  FROM o WHERE compat IS NOT NULL AND NOT (m = 5 AND am % 3 = 0 AND course <> 'dessert') AND NOT (m = 7 AND course IN ('sauce/condiment', 'side', 'bread')) AND NOT (am % 2 = 0 AND course = 'sauce/condiment')),
u AS (SELECT *, row_number() OVER (PARTITION BY anchor, course ORDER BY exact DESC, title, id) AS n FROM s)
SELECT anchor, id, course, exact AS score, row_number() OVER (PARTITION BY anchor ORDER BY exact DESC, title, id) AS place FROM u WHERE n <= CASE course WHEN 'side' THEN 2 WHEN 'salad' THEN 2 ELSE 1 END QUALIFY place <= 6""")
def meals_around_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meal around every part. Parts of one type, size band and number mod 12 are of a kind."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    own = F.round(k % 10 / 10 * 0.5 + F.when(k % 5 == 0, 0.4).otherwise(0.0) + 0.3 * F.greatest(F.lit(-2), F.least(F.lit(2), k % 7 - 3)), 9)
    band = F.floor(F.col("p_size") / 10)
    kind = F.struct(F.col("p_type").alias("tag"), band.alias("band"), (k % 12).alias("m"))
    dishes = part.select(k.alias("id"), F.col("p_name").alias("title"), kind.alias("kind"), own.alias("own"))

    known = spark.createDataFrame(_REGIONS, "tag string, region string, weight double")
    every = dishes.select("kind").distinct()
    weights = every.select("kind", F.col("kind.tag").alias("tag")).join(F.broadcast(known), "tag").select(F.col("kind").alias("id"), "region", "weight")
    near = every.select(F.col("kind").alias("anchor"), F.explode(F.array(*[F.col("kind.band") + n for n in (-1, 0, 1)])).alias("band"))
    pairs = near.join(every.select(F.col("kind").alias("id"), F.col("kind.band").alias("band")), "band").drop("band")
    shared = pairs.filter(F.col("anchor.tag").eqNullSafe(F.col("id.tag"))).select(F.col("anchor").alias("a"), F.col("id").alias("b"))
    links = spark.createDataFrame(_LINKS, "left string, right string, link double")
    affinity = pairings.affinity_of(weights, weights, links, shared).select(F.col("a").alias("anchor"), F.col("b").alias("id"), "affinity")
    tagged = lambda c: F.coalesce(F.col(f"{c}.tag").isin(sorted({t for t, _, _ in _REGIONS})), F.lit(False))
    am, m = F.col("anchor.m"), F.col("id.m")
    mine = F.when(am % 3 == 0, F.array(F.lit("main"))).when(am % 3 == 1, F.array(F.lit("soup"), F.lit("side"))).otherwise(F.array(F.lit("salad")))
    first = F.when(m % 3 == 0, "side").when(m % 3 == 1, "bread").otherwise("dessert")
    courses = F.array(first, F.lit("sauce/condiment"), F.when(m % 4 == 0, "soup").otherwise("main"))
    rows = pairs.join(affinity, ["anchor", "id"], "left").withColumn("o", F.explode(pairings.course_options(mine, courses))).select(
        "anchor", "id", F.lit("").alias("title"), F.coalesce("affinity", F.lit(0.0)).alias("affinity"), tagged("anchor").alias("anchor_has"), tagged("id").alias("has"), "o.course", "o.complement",
        (m % 2 == 0).alias("neutral"), (m == 5).alias("sweet"), (am % 3 == 0).alias("savory"), (m % 6 / 5).alias("contrast"), F.lit(0.0).alias("similarity"), (m % 4 == 0).alias("both_meaty"),
        F.lit(False).alias("favourite"), F.lit(0).alias("votes"), (m == 7).alias("component"), (am % 2 == 0).alias("anchor_wet"),
    )
    kinds = pairings.scored_pairs(rows).select(F.col("anchor").alias("anchor_kind"), F.col("id").alias("kind"), "course", F.col("exact").alias("base"))
    return pairings.meals_for_all(dishes, kinds)


@query(_ANCHOR_SQL + """
s AS (SELECT anchor, id, title, round((CASE WHEN k % 2 = 0 THEN (k % 10) / 10 ELSE 0.3 * 2 + 0.3 * affinity END + 0.25 * affinity + CASE WHEN k % 3 = 0 THEN 0.08 ELSE 0 END)::DOUBLE, 3) AS score FROM p
WHERE k % 13 <> 0 AND NOT (anchor_has AND has AND affinity < 0.6) AND NOT (anchor_has AND NOT has AND NOT plain AND k % 2 = 1))
SELECT anchor, id, score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, title, id) AS place FROM s QUALIFY place <= 6 AND score > 0""")
def more_like_this(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts like three anchors; the length of a list is the feature."""
    k = F.col("id")
    pairs = _pairs(spark, sf_dir).select(
        "*", (k % 13 != 0).alias("shares_course"), F.lit(True).alias("same_component"), (k % 2 == 1).alias("marked"),
        F.when(k % 2 == 0, k % 10 / 10).alias("similarity"), F.lit(2).alias("shared_courses"), (k % 3 == 0).alias("same_family"),
    )
    return pairings.more_like(pairs)


@query()
def duplicate_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as drafts against all of them, by title (first line) and words."""
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.concat(F.lit("u"), (F.col("item_id") % 30).cast("string")).alias("url"),
        text.letters_only(F.substring_index(F.col("text"), ".", 1)).alias("title"), text.tokens(F.col("text")).alias("names"),
    )
    return matching.duplicates(items, items).filter("draft <> id")


@query("""WITH a AS (SELECT s_suppkey AS id, s_nationkey AS title, s_suppkey % 2 AS host FROM supplier WHERE s_acctbal >= 0), b AS (SELECT c_custkey AS id, c_nationkey AS title, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_custkey % 3 END AS host FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0),
h AS (SELECT b.id AS b, min(a.id) AS a FROM a JOIN b ON a.title = b.title AND (a.host IS NULL OR b.host IS NULL OR a.host = b.host) GROUP BY 1 HAVING count(*) = 1)
SELECT a, min(b) AS b FROM h GROUP BY 1""")
def exact_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: empty records with one exact title on the other side; those with a debt are matched already."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("title"), (F.col("s_suppkey") % 2).alias("host"), "s_acctbal")
    k = F.col("c_custkey")
    b = table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").alias("title"), F.when(k % 2 != 0, k % 3).alias("host"), (F.col("c_mktsegment") == "BUILDING").alias("empty"), "c_acctbal")
    matched = a.filter("s_acctbal < 0").select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(
        b.filter("c_acctbal < 0").select(F.lit(None).cast("long").alias("a"), F.col("id").alias("b"))
    )
    return matching.only_exact(a.drop("s_acctbal"), b.drop("c_acctbal"), matched)


@query("""WITH p AS (SELECT l_orderkey AS a, l_linenumber AS b, round(l_discount * 10, 2) AS title, round(l_tax * 10, 2) AS jaccard, CASE WHEN l_returnflag = 'R' THEN 'same canonical URL' WHEN round(l_discount * 10, 2) >= 0.7 AND round(l_tax * 10, 2) >= 0.7 THEN 'title + ingredients (>= 0.7)'
WHEN round(l_discount * 10, 2) >= 0.7 AND l_linestatus = 'O' THEN 'same title, one side empty' WHEN round(l_discount * 10, 2) >= 0.75 OR (round(l_tax * 10, 2) >= 0.4 AND round(l_discount * 10, 2) >= 0.5) THEN 'possible' END AS kind,
l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS a_matched, l_linenumber <= 3 AS b_matched, l_suppkey % 3 = 0 AS other FROM lineitem)
SELECT a, b, title, jaccard, kind, a_matched, b_matched, concat_ws(', ', CASE WHEN title >= 0.75 THEN 'similar title' END, CASE WHEN jaccard >= 0.4 THEN 'ingredient overlap' END, CASE WHEN other THEN 'different source sites' END) AS why
FROM p WHERE (title >= 0.75 OR (jaccard >= 0.4 AND title >= 0.5)) AND NOT (a_matched AND b_matched)""")
def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M6: lines as scored pairs: those worth a look, as orders with a return and numbers up to three are matched, their kind and why."""
    title, jac = F.round(F.col("l_discount") * 10, 2), F.round(F.col("l_tax") * 10, 2)
    kind = matching.pair_class(F.col("l_returnflag") == "R", title, jac, F.col("l_linestatus") == "O")
    lines, a, b = table(spark, sf_dir, "lineitem"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")
    pairs = lines.select(a, b, title.alias("title"), jac.alias("jaccard"), kind.alias("kind"), (F.col("l_suppkey") % 3 == 0).alias("other_site"))
    returned = lines.filter("l_returnflag = 'R'").select(a, F.lit(None).cast("int").alias("b"))
    matched = returned.distinct().unionByName(lines.filter("l_linenumber <= 3").select(F.lit(None).cast("long").alias("a"), b).distinct())
    return matching.review_band(pairs, matched).drop("other_site")


@query("""WITH p AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'N' OR l_linestatus <> 'F') AS n_edits FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey, o_custkey % 5 AS version, o_orderstatus = 'P' AS archived, n, n_edits, ['pending', 'applied', 'deleted', 'error', 'nochange'][1 + n % 5] AS status FROM orders LEFT JOIN p ON l_orderkey = o_orderkey)
SELECT o_orderkey, coalesce(status, 'unreviewed') AS status, coalesce(n_edits, 0) AS n_edits, coalesce(status IN ('pending', 'nochange', 'error') AND n % 4 <> version, false) AS stale
FROM s WHERE NOT archived OR status = 'deleted'""")
def reviewed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items, their lines as what was proposed for them; orders without lines nobody has looked at."""
    edit = F.struct(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("before"), F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).otherwise("").alias("after"))
    made = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.collect_list(edit).alias("edits"))
    status = F.element_at(F.array(*map(F.lit, ["pending", "applied", "deleted", "error", "nochange"])), (F.col("n") % 5 + 1).cast("int"))
    made = made.select("o_orderkey", status.alias("status"), (F.col("n") % 4).alias("base_version"), "edits")
    items = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("version"), (F.col("o_orderstatus") == "P").alias("archived"))
    return history.review_items(items, made, "o_orderkey").select("o_orderkey", "status", F.size("edits").cast("long").alias("n_edits"), "stale")


@query()
def line_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of turns that their document of the same number has, nearly."""
    lines = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("key"), F.explode(F.split("text", "\n")).alias("line")).filter("length(line) > 0")
    return matching.line_recall(lines("conversations", "conv_id"), lines("benchmark", "item_id"), "key")


@query("""WITH n AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations),
o AS (SELECT conv_id, role, turn AS id, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE turn % 2 = 0)
SELECT n.conv_id, n.turn, o.id FROM n LEFT JOIN o ON o.conv_id = n.conv_id AND o.role = n.role AND o.n = n.n""")
def kept_line_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as edited lines, their role as the text; even turns are the old lines."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("text"))
    old = rows.filter("turn % 2 = 0").select("conv_id", "text", F.col("turn").alias("id"), F.col("turn").alias("place"))
    return matching.same_text_ids(old, rows.select("conv_id", "text", F.col("turn").alias("place")), "conv_id").select("conv_id", F.col("place").alias("turn"), "id")


@query("""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', ' ', 'g') AS title, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS sorted,
'The ' || upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' of ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS cased,
list_sort([p_size::VARCHAR, '3', '1/2']) AS numbers, p_size % 2 = 0 AS trivial FROM part""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as titles, aliases, shouted titles and lines with numbers."""
    name = F.col("p_name")
    first, second = F.element_at(F.split(name, " "), 1), F.element_at(F.split(name, " "), 2)
    shouted = F.concat(F.lit("THE "), F.upper(first), F.lit(" OF "), F.upper(second))
    line = F.concat(F.lit("Three ½ "), F.col("p_size").cast("string"), F.lit(" "), name)
    edited = F.concat(F.lit("three 1/2 "), (F.col("p_size") + F.col("p_size") % 2).cast("string"), F.lit("  "), name, F.lit("."))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.title_key(F.concat(F.lit("The "), name, F.lit(" (new) Recipe"))).alias("title"), text.alias_keys(name)["sorted"].alias("sorted"),
        text.title_case(shouted).alias("cased"), text.numbers(line).alias("numbers"), text.trivial_edit(line, edited).alias("trivial"),
    )


@query("""SELECT doc_id, 'title' || chr(10) || 'Tags: ' || lang || chr(10) || 'Ingredients: ' || source || chr(10) || 'Method: ' || left(text, 1500) AS body, sha256('m' || chr(10) || text) AS hash FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL""")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be embedded of each document; its limits are the feature."""
    docs = table(spark, sf_dir, "documents").filter("text is not null and lang is not null and source is not null")
    body = text.embedding_text(F.lit("title"), F.lit(""), F.array("lang"), F.array("source"), F.array("text"))
    return docs.select("doc_id", body.alias("body"), text.content_hash("m", F.col("text")).alias("hash"))


@query(r"""WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, CASE WHEN len(s) > 0 THEN list_reduce(list_transform(s, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1] || ' ' || x[1]) > 700 THEN list_concat(a, x) ELSE list_concat(a[:-2], [a[-1] || ' ' || x[1]]) END) END AS p FROM s),
c AS (SELECT doc_id, CASE WHEN length(text) > 800 AND array_to_string(p, ' ') = text THEN p ELSE [text] END AS parts FROM p)
SELECT doc_id, len(parts)::INT AS n_parts, list_max(list_transform(parts, lambda x: length(x)))::INT AS longest, sha256(array_to_string(parts, '|')) AS parts FROM c""")
def packed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at sentence ends where that loses nothing: how many parts, the longest of them, and all of them."""
    parts = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.packed_sentences(F.col("text")).alias("p"))
    longest = F.array_max(F.transform("p", F.length))
    return parts.select("doc_id", F.size("p").alias("n_parts"), longest.alias("longest"), F.sha2(F.array_join("p", "|"), 256).alias("parts"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at, nullif(concat_ws(' ', CASE WHEN o_custkey >= 60 THEN (o_custkey // 60) || ' hr' END, CASE WHEN o_custkey % 60 > 0 THEN (o_custkey % 60) || ' min' END), '') AS said,
20 AS prep, CASE WHEN o_custkey % 90 > 0 THEN o_custkey % 90 END::INT AS cook FROM orders""")
def time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of orders as ISO texts, minutes as words, and times in notes."""
    orders = table(spark, sf_dir, "orders")
    notes = F.array(F.lit("Prep time: 20 minutes"), F.lit("Cook: until done"), F.concat(F.lit("Cook: "), (F.col("o_custkey") % 90).cast("string"), F.lit(" min")))
    times = durations.note_times(notes, {"prep time": "prep", "cook": "cook"})
    return orders.select(
        "o_orderkey", durations.iso_time(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("at"), durations.hours_and_minutes(F.col("o_custkey")).alias("said"),
        times["prep"].alias("prep"), times["cook"].alias("cook"),
    )


_CHECKS = {
    "orders: missing customer": "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "lines: missing order": "SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "lines: missing part": "SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)",
    "lines: missing supplier": "SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)",
    "customers: missing nation": "SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)",
    "suppliers: missing nation": "SELECT count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)",
    "nations: missing region": "SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)",
    "labels: missing document": "SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "customers: orphan": "SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "orders: empty": "SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "orders: repeated key": "SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)",
    "parts: repeated key": "SELECT count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)",
    "events: repeated key": "SELECT count(*) FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1)",
    "lines: repeated number": "SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)",
    "lines: quantity": "SELECT count(*) FROM lineitem WHERE NOT l_quantity > 0",
    "lines: discount": "SELECT count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 1)",
    "lines: shipped before the order": "SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate",
    "orders: status": "SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P')",
    "parts: size": "SELECT count(*) FROM part WHERE NOT (p_size BETWEEN 1 AND 50)",
    "parts: price": "SELECT count(*) FROM part WHERE NOT p_retailprice > 0",
    "documents: length": "SELECT count(*) FROM documents WHERE length(text) IS DISTINCT FROM n_chars",
    "labels: value": "SELECT count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)",
    "turns: role": "SELECT count(*) FROM conversations WHERE coalesce(role, '') NOT IN ('user', 'assistant', 'system')",
    "events: future": "SELECT count(*) FROM events WHERE ts > TIMESTAMP '2030-01-01'",
    "ledger: events by user": "SELECT abs((SELECT count(*) FROM events) - (SELECT sum(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id)))::BIGINT",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS \"check\", ({sql}) AS bad, ({sql}) = 0 AS ok" for name, sql in _CHECKS.items()))
def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 checks of references, keys, ranges and sums, a row each."""
    t = lambda name: table(spark, sf_dir, name)
    missing = lambda a, x, b, y: t(a).join(t(b).select(F.col(y).alias("_y")), F.col(x) == F.col("_y"), "left_anti").filter(F.col(x).isNotNull())
    twice = lambda a, *keys: t(a).groupBy(*keys).count().filter("count > 1")
    shipped = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey").filter("l_shipdate < o_orderdate")
    by_user = t("events").groupBy("user_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"))
    apart = t("events").agg(F.count("*").alias("m")).crossJoin(by_user).select(F.explode(F.sequence(F.lit(0), F.abs(F.col("m") - F.col("n")))).alias("x")).filter("x > 0")
    found = [
        missing("orders", "o_custkey", "customer", "c_custkey"), missing("lineitem", "l_orderkey", "orders", "o_orderkey"), missing("lineitem", "l_partkey", "part", "p_partkey"),
        missing("lineitem", "l_suppkey", "supplier", "s_suppkey"), missing("customer", "c_nationkey", "nation", "n_nationkey"), missing("supplier", "s_nationkey", "nation", "n_nationkey"),
        missing("nation", "n_regionkey", "region", "r_regionkey"), missing("labels", "doc_id", "documents", "doc_id"), missing("customer", "c_custkey", "orders", "o_custkey"),
        missing("orders", "o_orderkey", "lineitem", "l_orderkey"), twice("orders", "o_orderkey"), twice("part", "p_partkey"), twice("events", "event_id"),
        twice("lineitem", "l_orderkey", "l_linenumber"), t("lineitem").filter("not l_quantity > 0"), t("lineitem").filter("not (l_discount between 0 and 1)"), shipped,
        t("orders").filter("o_orderstatus not in ('O', 'F', 'P')"), t("part").filter("not (p_size between 1 and 50)"), t("part").filter("not p_retailprice > 0"),
        t("documents").filter("not (length(text) <=> n_chars)"), t("labels").filter("quality not in (0, 1) or toxic not in (0, 1)"),
        t("conversations").filter("coalesce(role, '') not in ('user', 'assistant', 'system')"), t("events").filter("ts > timestamp_ntz'2030-01-01'"), apart,
    ]
    return rules.audit(dict(zip(_CHECKS, found, strict=True)))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '\\s+', ' ', 'g')) AS title, lower(regexp_extract(html, '<html lang="([^"]*)"', 1)) AS lang FROM pages""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages say of themselves."""
    return web.page_metadata(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "title", "lang")


@query("SELECT o_custkey, count(*) AS n, sha256(string_agg('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}', chr(10) ORDER BY o_orderkey)) AS etag FROM orders GROUP BY 1")
def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines, written to shared storage and read again, and the hash of each customer's."""
    lines = nested.catalog_json(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"], keep=["o_custkey", "o_orderkey"])
    kept = materialise(lines, "catalog-lines")
    own = kept.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("o_orderkey", "json"))).alias("j"))
    return own.select("o_custkey", "n", F.sha2(F.array_join("j.json", "\n"), 256).alias("etag"))


@query("SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last, sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS before FROM orders GROUP BY 1")
def rebuilt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the orders are copied as a table, which is then rebuilt from all; who had the first version still reads it."""
    root = f"{shared_dir(spark)}/galley/rebuilt-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    publish(orders.filter("o_orderkey % 2 = 0"), root)
    first = published(spark, root)
    publish(orders, root)
    before = first.groupBy("o_custkey").agg(F.count("*").alias("before"))
    now = published(spark, root).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    return now.join(before, "o_custkey", "left").fillna(0, ["before"])


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 100 END AS k, CASE WHEN event_id % 7 = 0 THEN 'malformed' ELSE NULL END AS issue FROM events")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that can't be read go on with an issue, the others without one."""
    doc = F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.concat(F.lit('{"k": '), (F.col("event_id") % 100).cast("string"), F.lit("}")))
    rows = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return nested.with_issues(rows, "doc", "k long").select("event_id", F.col("record.k").alias("k"), "issue")


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (WHERE turn % 2 = 0) AS a, count(*) FILTER (WHERE turn % 2 = 1) AS b, count(*) FILTER (WHERE text IS NOT NULL) AS n FROM conversations GROUP BY 1)
SELECT conv_id, a = b AND b = n // 2 AS exact, abs(a - b) <= 1 AND (abs(b - n // 2) <= greatest(1, round_even(b * 0.25, 0)) OR (b % 3) / 2.0 >= 0.9) AS tolerant FROM c""")
def extraction_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the two sides as true numbers, their halves as those found, and a step score from a number of turns."""
    at = lambda k: F.count_if(F.col("turn") % 2 == k)
    sizes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(at(0).alias("a"), at(1).alias("b"), F.count("text").alias("n"))
    exact, tolerant = matching.extraction_verdict((F.col("a"), F.col("b")), (F.col("b"), F.floor(F.col("n") / 2)), F.col("b") % 3 / 2.0)
    return sizes.select("conv_id", exact.alias("exact"), tolerant.alias("tolerant"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[^ \\t-\\r]')) AS n_marks, text IS NOT NULL AS fits FROM documents""")
def bounded_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as parts of at most 2,000 characters, which keep all that is not white space."""
    parts = table(spark, sf_dir, "documents").select("doc_id", text.bounded_parts(F.col("text")).alias("p"))
    marks = F.length(F.regexp_replace(F.array_join("p", ""), r"[ \t-\r]", "")).cast("long")
    return parts.select("doc_id", marks.alias("n_marks"), F.coalesce(F.forall("p", lambda x: F.length(x) <= 2000), F.lit(False)).alias("fits"))


_YIELDS = {
    "'Serves ' || p_size": ("p_size::DOUBLE", "NULL"),
    "'Makes ' || p_size || ' cookies'": ("p_size::DOUBLE", "NULL"),
    "'About ' || p_size || ' to ' || (p_size + 2)": ("p_size::DOUBLE", "NULL"),
    "'Yield: ' || p_size || ' cups'": ("NULL", "'volume/whole-dish yield, not servings'"),
    "'Servings (' || p_size || ' g each)'": ("NULL", "'serving size only, no count'"),
    "'serving: ' || p_size || 'bar'": ("NULL", "'serving size only, no count'"),
    "p_size || ' (in two pans)'": ("p_size::DOUBLE", "'leading count assumed to be servings'"),
    "'Two ' || p_size || ' inch pieces'": ("2.0", "NULL"),
    "'enough'": ("NULL", "'no number'"),
    "'fills ' || p_size || ' moulds'": ("NULL", "'unrecognized yield'"),
}


def _case(column: str, values: list[str]) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


@query(f"SELECT p_partkey, {_case('p_partkey', [n for n, _ in _YIELDS.values()])} AS servings, {_case('p_partkey', [f for _, f in _YIELDS.values()])} AS flag FROM part")
def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: the sizes of parts in ten ways to say a yield."""
    said = F.expr(_case("p_partkey", list(_YIELDS)))
    got = labels.servings(said)
    return table(spark, sf_dir, "part").select("p_partkey", got["servings"].alias("servings"), got["flag"].alias("flag"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'course' WHEN '2-HIGH' THEN 'protein' WHEN '3-MEDIUM' THEN 'cuisine' ELSE 'personal' END AS kind,
CASE o_orderpriority WHEN '1-URGENT' THEN 'snack' WHEN '2-HIGH' THEN 'tofu/tempeh' WHEN '3-MEDIUM' THEN 'Thai' ELSE lower(o_orderpriority) || ': ' || lower(o_orderstatus) END AS value,
CASE o_orderstatus WHEN 'O' THEN 'equipment' WHEN 'F' THEN 'course' ELSE 'personal' END AS other_kind, CASE o_orderstatus WHEN 'O' THEN 'slow cooker' WHEN 'F' THEN 'side' ELSE 'difficulty: p' END AS other_value,
CASE o_orderstatus WHEN 'O' THEN 'fish' WHEN 'F' THEN 'Sichuan' ELSE NULL END AS modelled FROM orders""")
def tag_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities and states of orders as tags of people, of the other catalog and of a model."""
    by = lambda c, values, other: F.coalesce(amounts.lookup(values, F.col(c)), other)
    free = labels.free_tag(by("o_orderpriority", {"1-URGENT": " Appetizers ", "2-HIGH": "protein:  Tofu", "3-MEDIUM": "thai"}, F.concat_ws(":", "o_orderpriority", "o_orderstatus")))
    category = by("o_orderstatus", {"O": "cooking_method", "F": "meal_type"}, F.lit("difficulty"))
    other = labels.category_tag(category, by("o_orderstatus", {"O": "Slow Cooker", "F": "Side dish"}, F.col("o_orderstatus")))
    kind = by("o_orderstatus", {"O": "protein", "F": "cuisine"}, F.lit("diet"))
    modelled = labels.model_tag(kind, by("o_orderstatus", {"O": "Salmon", "F": "sichuan"}, F.lit("paleo")), labels.CUISINES)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", free["kind"].alias("kind"), free["value"].alias("value"), other["kind"].alias("other_kind"), other["value"].alias("other_value"), modelled.alias("modelled")
    )


@query(r"""WITH l AS (SELECT doc_id, source, k, trim(line, chr(32) || chr(9) || chr(13)) AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents)),
h AS (SELECT doc_id, k, line, trim(rtrim(line, ':')) AS v, source FROM l)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE v <> '' AND length(v) <= 60 AND NOT regexp_matches(v, '[,;]') AND (ends_with(line, ':') OR regexp_matches(lower(v), '^(for|to make) | ingredients?$')
 OR lower(v) IN ('cake', 'sauce', 'soup', 'salad', 'topping') OR (regexp_matches(v, '\p{L}') AND regexp_replace(v, '[^\p{L}]', '', 'g') = upper(regexp_replace(v, '[^\p{L}]', '', 'g'))))) AS headings,
count(*) FILTER (WHERE lower(rtrim(line, '.:')) IN ('share', 'recipe') OR regexp_matches(lower(rtrim(line, '.:')), '^[0-9]+\s+likes?$')) AS leftovers FROM h GROUP BY 1""")
def line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that look like a component's heading, and those an import leaves behind."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))
    line = F.btrim("line", F.lit(" \t\r"))
    heading, left = labels.component_heading(line, F.lit(False)), labels.leftover(line, F.lit(None).cast("string"), F.lit("no title"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(heading).alias("headings"), F.count_if(left).alias("leftovers"))


@query("""SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before, coalesce(text, '') AS after FROM conversations""")
def turn_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes from a turn to the next; what stays and goes is the one, what stays and comes the other."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("last"))
    parts = rows.select("conv_id", "turn", edits.word_diff(F.col("last"), F.col("text")).alias("p"))
    side = lambda gone: F.array_join(F.filter("p", lambda x: x["kind"] != gone)["text"], "")
    return parts.select("conv_id", "turn", side("ins").alias("before"), side("del").alias("after"))


_EDITS_SQL = """
WITH l AS (SELECT o_custkey AS doc, o_orderkey AS id, o_orderstatus AS section, 'Mix ' || o_orderkey || ' cups' AS text, o_orderpriority AS f, o_totalprice AS p FROM orders),
e AS (SELECT doc, id, CASE WHEN f = '5-LOW' THEN 'heading' WHEN f = '2-HIGH' THEN 'remove' ELSE 'edit' END AS op, CASE WHEN f = '5-LOW' THEN text WHEN f = '2-HIGH' THEN '' ELSE 'Mix ' || (id + 1) || ' cups' END AS after,
 f NOT IN ('2-HIGH', '5-LOW') AS numbers_changed FROM l WHERE f = '5-LOW' OR (p >= 50000 AND f <> '1-URGENT'))"""


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A customer's orders as lines of a document, and what is proposed for them: by priority, and once more for the lowest."""
    text_of = lambda k: F.concat(F.lit("Mix "), k.cast("string"), F.lit(" cups"))
    n = F.col("o_orderkey")
    lines = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc"), F.lit("step").alias("kind"), n.alias("id"), text_of(n).alias("text"), F.col("o_orderstatus").alias("section"), n.alias("place"),
        F.lit("start").alias("heading"), F.lit(False).alias("protected"), "o_orderpriority", "o_totalprice",
    )
    said = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat("text", F.lit("."))).when(F.col("o_orderpriority") == "2-HIGH", "").otherwise(text_of(F.col("id") + 1))
    reason = F.when(F.col("o_totalprice") < 50000, "already clean").otherwise("wording")
    first = lines.select("doc", "kind", "id", F.lit("rewrite").alias("action"), said.alias("text"), reason.alias("reason"), F.lit(1).alias("seq"))
    names = lines.filter("o_orderpriority = '5-LOW'").select("doc", "kind", "id", F.lit("remove").alias("action"), F.lit("").alias("text"), F.lit("a section name").alias("reason"), F.lit(2).alias("seq"))
    return lines, first.unionByName(names)


@query(_EDITS_SQL + "SELECT doc, id, op, after, numbers_changed FROM e")
def standing_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the edits proposed for lines those that stand, one a line."""
    lines, proposed = _edited(spark, sf_dir)
    return edits.normalised(proposed, lines).select("doc", "id", "op", "after", "numbers_changed")


@query(_EDITS_SQL + """, r AS (SELECT l.*, op, after, count(*) FILTER (WHERE op = 'heading') OVER w AS run, max(CASE WHEN op = 'heading' THEN id END) OVER w AS head
 FROM l LEFT JOIN e USING (doc, id) WINDOW w AS (PARTITION BY l.doc, section ORDER BY id))
SELECT doc, section, dense_rank() OVER (PARTITION BY doc, section ORDER BY run) - 1 AS part, CASE WHEN head IS NULL THEN 'start' ELSE 'Mix ' || head || ' cups' END AS heading, id, CASE WHEN op = 'edit' THEN after ELSE text END AS text
FROM r WHERE coalesce(op, '') NOT IN ('remove', 'heading')""")
def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines after their edits, their sections split where a line became a heading."""
    lines, proposed = _edited(spark, sf_dir)
    return edits.applied(lines, edits.normalised(proposed, lines)).drop("place")


@query("""WITH l AS (SELECT l_orderkey AS doc, l_returnflag || ' ' || l_linestatus || ' ' || l_linenumber AS text, l_tax < 0.005 AS low FROM lineitem), t AS (SELECT l_orderkey AS doc, l_linestatus || ' ' || l_linenumber || ' ' AS text, l_linestatus || ' ' || l_linenumber AS e, 'tail ' || l_linenumber AS x FROM lineitem WHERE l_discount > 0.08)
SELECT doc, text FROM l WHERE low OR EXISTS (SELECT 1 FROM t WHERE t.doc = l.doc AND contains(l.text, t.e)) UNION SELECT doc, x FROM t""")
def uncertain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders that need a look, as what was read with little confidence says them or is not among them."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_returnflag", "l_linestatus", "l_linenumber", "l_tax", "l_discount")
    lines = rows.select("doc", F.concat_ws(" ", "l_returnflag", "l_linestatus", "l_linenumber").alias("text"), F.when(F.col("l_tax") < 0.005, "low").otherwise("high").alias("confidence"))
    confidence = F.when(F.col("l_discount") > 0.08, "low").otherwise("high").alias("confidence")
    said = F.array(F.concat_ws(" ", "l_linestatus", "l_linenumber"), F.concat(F.lit("tail "), F.col("l_linenumber").cast("string")))
    return edits.uncertain(lines, rows.select("doc", F.explode(said).alias("text"), confidence))


_ITEMS_SQL = "WITH i AS (SELECT o_custkey AS list, o_orderkey AS pos, lower(o_orderpriority) AS key, o_orderpriority AS name, o_orderstatus AS unit, o_orderstatus = 'F' AS checked, o_totalprice < 5000 AS unnamed FROM orders)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items on their customer's list."""
    name = F.when(F.col("o_totalprice") < 5000, "  ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("list"), F.col("o_orderkey").alias("at"), name.alias("name"), F.lit("").alias("quantity"), F.col("o_orderstatus").alias("unit"), (F.col("o_orderstatus") == "F").alias("checked")
    )


@query(_ITEMS_SQL + "SELECT list, key, arg_min(name, pos) AS name, arg_min(unit, pos) AS unit, min(pos) AS first, count(*) AS n_sources FROM i WHERE NOT checked AND NOT unnamed GROUP BY 1, 2")
def moved_shopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open items of each list, those of one name as one."""
    return moves.shopping(_items(spark, sf_dir), "at").drop("quantity")


@query(_ITEMS_SQL + """SELECT count(*) AS in_source, count(*) FILTER (WHERE checked) AS checked, count(*) FILTER (WHERE NOT checked AND unnamed) AS unnamed,
count(DISTINCT CASE WHEN NOT checked AND NOT unnamed THEN list || '/' || key END) AS migrated, count(*) FILTER (WHERE NOT checked AND NOT unnamed) - count(DISTINCT CASE WHEN NOT checked AND NOT unnamed THEN list || '/' || key END) AS merged FROM i""")
def shopping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every item went."""
    return moves.shopping_counts(_items(spark, sf_dir))


@query("""SELECT o_orderdate::DATE AS day, o_orderkey AS id, s_name AS recipe, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 3 ELSE 10 END, o_orderkey) - 1 AS position,
CASE o_orderstatus WHEN 'O' THEN 'breakfast · ' || o_orderpriority WHEN 'F' THEN 'dinner · ' || o_orderpriority ELSE 'tea · ' || o_orderpriority END AS note FROM orders JOIN supplier ON s_suppkey = o_custkey""")
def moved_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as planned meals, in place within their day; those whose recipe (supplier) has not moved stay behind."""
    meal = F.when(F.col("o_orderstatus") == "O", "breakfast").when(F.col("o_orderstatus") == "F", "dinner").otherwise("tea")
    meals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), meal.alias("meal"), F.col("o_custkey").alias("recipe"), F.col("o_orderpriority").alias("notes"))
    moved = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("recipe"), F.col("s_name").alias("new"))
    return moves.plan_entries(meals, moved)


@query("""WITH s AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1)
SELECT 0 AS part, row_number() OVER (ORDER BY status) + 1 AS line, '| ' || status || ' | ' || n || ' |' AS text FROM s UNION ALL SELECT 1, row_number() OVER (ORDER BY priority) + 1, '| ' || priority || ' | ' || n || ' |' FROM p
UNION ALL VALUES (0, -1, '## Status'), (0, 0, '| status | n |'), (0, 1, '|---|---|'), (1, -1, '## Priority'), (1, 0, '| priority | n |'), (1, 1, '|---|---|')""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of orders as the lines of a report, two tables below a heading each."""
    counts = lambda c, name: table(spark, sf_dir, "orders").groupBy(F.col(c).alias(name)).agg(F.count("*").alias("n"))
    status, priority = counts("o_orderstatus", "status"), counts("o_orderpriority", "priority")
    return report.sections({"Status": report.table_lines(status, ["status"]), "Priority": report.table_lines(priority, ["priority"])})


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 2 THEN NULL ELSE p_size::VARCHAR END AS quantity, CASE p_size % 3 WHEN 0 THEN 'cups' WHEN 1 THEN 'g' END AS unit, p_name AS name,
CASE p_size % 3 WHEN 0 THEN p_size || ' cups ' || p_name END AS us, CASE p_size % 3 WHEN 0 THEN (p_size * 240) || ' ml ' || p_name END AS metric FROM part""")
def ingredient_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as ingredient lines with two measures, one and none."""
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    double = F.concat(size, F.lit(" cups / "), (F.col("p_size") * 240).cast("string"), F.lit(" ml  "), name)
    line = F.when(F.col("p_size") % 3 == 0, double).when(F.col("p_size") % 3 == 1, F.concat(size, F.lit("g "), name)).otherwise(name)
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", labels.ingredient(line).alias("i")).select("p_partkey", "i.*")


@query("""SELECT p_partkey, p_name AS title, CASE WHEN split_part(p_name, ' ', 1) = 'cold' THEN 'Cold Kitchen' END AS credit, CASE WHEN split_part(p_name, ' ', 1) = 'hot' THEN 'hot/slow cooker' ELSE 'slow cooker' END AS tags FROM part""")
def title_clean_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as titles between the name of their site (brand) and its recipes, and whom they name."""
    name = F.col("p_name")
    site = F.concat(F.lit("www."), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit(".example"))
    title = labels.clean_title(F.concat(F.col("p_brand"), F.lit(" - "), name, F.lit("  | "), F.col("p_brand"), F.lit(" Recipes")), site)
    notes = labels.title_notes(F.concat(name, F.lit(" in a Slow Cooker")), {"cold": (["cold"], "Cold Kitchen", None), "hot": (["hot"], None, ("flavour", "hot"))})
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", title.alias("title"), notes["credit"].alias("credit"), F.array_join(notes["tags"]["value"], "/").alias("tags"))


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'content left out' WHEN 2 THEN 'step not in the source; content left out' ELSE 'title is an address or empty; title not in the source; yield left out' END AS issues,
round(CASE p_size % 4 WHEN 1 THEN 0.75 WHEN 2 THEN 1 / 3.0 ELSE 1 END::DOUBLE, 6) AS coverage FROM part""")
def checked_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as recipes in words, and four ways to extract them: whole, short, invented, and without title and yield."""
    k, brand = F.col("p_size") % 4, F.concat(F.lit("2 "), F.col("p_brand"))
    mix = F.concat(F.lit("Mix "), F.col("p_type"), F.lit(" well"))
    source = F.concat_ws("\n", "p_name", F.lit("Serves 4"), F.lit("Ingredients:"), brand, F.lit("salt"), F.lit("Method"), mix, F.lit("Notes"), F.lit("keeps"))
    docs = spread(table(spark, sf_dir, "part"), "p_partkey").select(
        F.col("p_partkey").alias("id"), source.alias("source"), F.when(k == 3, "www.kitchen.example").otherwise(F.col("p_name")).alias("title"), F.when(k != 3, "4").alias("yield_text"),
        F.when(k == 1, F.array(brand)).otherwise(F.array(brand, F.lit("Salt"))).alias("ingredients"), F.array(F.when(k == 2, F.concat(F.lit("Bake "), F.col("p_type"))).otherwise(mix)).alias("steps"),
    )
    return extraction.checked(docs).select("id", F.array_join("issues", "; ").alias("issues"), F.round("coverage", 6).alias("coverage"))
