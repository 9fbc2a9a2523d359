"""Queries over the test tables, one for each kind of operator, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.functions import amounts, durations, text, urls
from galley.operators import aggregates, coverage, history, matching, ranking, rules, search
from galley.sources.tables import table, tasks_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


money = lambda c: F.col(c).cast("decimal(18,2)")


@query("""
SELECT c.c_custkey, c.c_name, coalesce(o.n_orders, 0) AS n_orders, o.last_order, coalesce(o.orders, '') AS orders
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, max(o_orderdate) AS last_order,
  string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey""")
def catalog_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    got = aggregates.with_children(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name"),
        orders,
        "c_custkey",
        "orders",
        [F.count("*").alias("n_orders"), F.max("o_orderdate").alias("last_order")],
        F.col("o_orderkey"),
    )
    return got.select(
        "c_custkey",
        "c_name",
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
        "last_order",
        F.array_join(F.col("orders").cast("array<string>"), ",").alias("orders"),
    )


@query("""SELECT l_partkey, sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END)::BIGINT AS votes
FROM lineitem GROUP BY 1""")
def signed_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vote = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(vote).alias("votes"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY 1")
def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("high")
    )


@query("SELECT count(*)::VARCHAR || ':' || strftime(max(o_orderdate), '%Y-%m-%d') AS stamp FROM orders")
def change_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.change_stamp(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("at")), "at")


@query("""SELECT o_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_key,
md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS print FROM orders GROUP BY 1""")
def group_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        (F.coalesce(F.max(key), F.lit(0)) + 1).alias("next_key"),
        F.md5(F.array_join(F.sort_array(F.collect_list(key)).cast("array<string>"), ",")).alias("print"),
    )


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(large, "p_partkey", "left_anti")


@query("""SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE l.doc_id IS NULL OR l.quality IS DISTINCT FROM 1 OR nullif(l.toxic, 0) IS NOT NULL""")
def stale_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("version"), F.nullif("toxic", F.lit(0)).alias("error"))
    return history.stale(table(spark, sf_dir, "documents").select("doc_id", "lang"), done, "doc_id", 1)


@query("""SELECT o.o_orderkey, c.c_name, o.o_orderdate FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderdate BETWEEN DATE '1996-03-01' AND DATE '1996-03-01' + 41""")
def date_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, days = F.lit("1996-03-01").cast("date"), F.least(F.greatest(F.lit(90), F.lit(1)), F.lit(42))
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderdate").between(start, F.date_add(start, days - 1)))
    return orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderdate")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a feed, newest first: the limit is the feature."""
    events = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.offset(100).limit(50).select("event_id", "user_id", "event_type")


@query("""SELECT k.k AS wanted, coalesce(a.c_custkey, b.c_custkey) AS c_custkey FROM
(SELECT DISTINCT CASE WHEN o_custkey % 2 = 0 THEN o_custkey::VARCHAR ELSE 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') END AS k FROM orders) k
LEFT JOIN customer a ON a.c_custkey::VARCHAR = k.k LEFT JOIN customer b ON b.c_name = k.k""")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    )
    wanted = table(spark, sf_dir, "orders").select(key.alias("wanted")).distinct()
    by_id = c.select(F.col("c_custkey").cast("string").alias("wanted"), F.col("c_custkey").alias("first"))
    by_name = c.select(F.col("c_name").alias("wanted"), F.col("c_custkey").alias("second"))
    both = wanted.join(by_id, "wanted", "left").join(by_name, "wanted", "left")
    return both.select("wanted", F.coalesce("first", "second").alias("c_custkey"))


_BRANDS, _SIZES = ["Brand#2", "Brand#17"], ["5", "7", "11"]


@query("""WITH r AS (SELECT p_brand AS brand, p_type AS type, p_size::VARCHAR AS size FROM part),
c AS (SELECT 'brand' AS facet, brand AS value, count(*) AS n FROM r WHERE size IN ('5','7','11') GROUP BY 2
UNION ALL SELECT 'size', size, count(*) FROM r WHERE brand IN ('Brand#2','Brand#17') GROUP BY 2
UNION ALL SELECT 'type', type, count(*) FROM r WHERE brand IN ('Brand#2','Brand#17') AND size IN ('5','7','11') GROUP BY 2
UNION ALL SELECT 'brand', unnest(['Brand#2','Brand#17']), 0 UNION ALL SELECT 'size', unnest(['5','7','11']), 0)
SELECT facet, value, max(n) AS n FROM c GROUP BY 1, 2""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.array(F.col(c).cast("string"))
    rows = table(spark, sf_dir, "part").select(one("p_brand").alias("brand"), one("p_type").alias("type"), one("p_size").alias("size"))
    return aggregates.facet_counts(rows, {k: k for k in ("brand", "type", "size")}, {"brand": _BRANDS, "size": _SIZES})


@query("""SELECT p_partkey, p_brand, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand
ORDER BY p_retailprice DESC, p_name, p_partkey) <= CASE WHEN p_brand LIKE '%1' THEN 2 ELSE 1 END""")
def capped_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    cap = F.when(F.endswith("p_brand", F.lit("1")), 2).otherwise(1)
    return ranking.capped_top(rows, "p_brand", [F.desc("p_retailprice"), F.col("p_name"), F.col("p_partkey")], cap).drop("p_name")


@query("""SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) AS turn
FROM (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages) QUALIFY turn <= 2""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("host"), "page_id")
    return ranking.round_robin(pages, "host", [F.col("page_id")], 2)


@query("""SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source
ORDER BY sha256(doc_id::VARCHAR), doc_id) <= 3""")
def hash_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.hash_quota(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 3)


@query("""WITH k AS (SELECT o_orderkey AS id, o_orderpriority AS title, p.p_name AS key, bool_and(p.p_size <= 20 OR p.p_type ILIKE 'small%') AS have
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part p ON p_partkey = l_partkey GROUP BY 1, 2, 3)
SELECT id, title, count(*) FILTER (WHERE NOT have) AS to_buy_count,
round_even(count(*) FILTER (WHERE NOT have) * 100.0 / count(*), 0)::INT AS percent_to_buy FROM k GROUP BY 1, 2""")
def coverage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's parts, how many are not at hand; a name is if all its parts are small ones."""
    # Each join's rows are dealt by their number: Spark would cut tasks by bytes, and short rows take many times their bytes in memory.
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey")
    tasks = tasks_for(lines, 500_000)
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("key"), ((F.col("p_size") <= 20) | F.ilike("p_type", F.lit("small%"))).alias("have")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    return coverage.missing_share(lines.repartition(tasks, "l_partkey").join(part, "l_partkey").repartition(tasks, "id").join(orders, "id"))


_UNITS = {"A": "cup", "N": "tbsp", "R": "lb"}


@query("""WITH l AS (SELECT l_partkey AS name, CASE l_returnflag WHEN 'R' THEN 'mass' ELSE 'volume' END AS family,
CASE l_returnflag WHEN 'A' THEN 'cup' WHEN 'N' THEN 'tbsp' ELSE 'lb' END AS unit,
CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity::DECIMAL(18,3) END AS q,
CASE l_returnflag WHEN 'A' THEN 236.590 WHEN 'N' THEN 14.787 ELSE 453.590 END::DECIMAL(9,3) AS per, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)
SELECT name, family, nullif(sum(q * per), 0)::DOUBLE AS base, bool_or(q IS NULL) AS partial, arg_min(unit, ord) AS hint, count(*) AS n
FROM l GROUP BY 1, 2""")
def unit_aware_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = amounts.lookup(_UNITS, F.col("l_returnflag"))
    kind = amounts.family(unit)
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("name"),
        kind["family"].alias("family"),
        unit.alias("unit"),
        kind["per"].cast("decimal(9,3)").alias("per"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("decimal(18,3)")).alias("quantity"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    got = aggregates.unit_sum(lines, "quantity", "per", "unit", "ord")
    return got.withColumn("base", F.col("base").cast("double"))


@query("""SELECT l_orderkey, total::DOUBLE AS total, matched::DOUBLE AS matched, round((matched * 100)::DOUBLE / total::DOUBLE, 1) AS share,
CASE WHEN round((matched * 100)::DOUBLE / total::DOUBLE, 1) >= 90 THEN 'high' WHEN round((matched * 100)::DOUBLE / total::DOUBLE, 1) >= 70 THEN 'medium' ELSE 'low' END AS badge
FROM (SELECT l_orderkey, sum(l_quantity::DECIMAL(18,2)) AS total, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity::DECIMAL(18,2) ELSE 0 END) AS matched FROM lineitem GROUP BY 1)""")
def weighted_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", money("l_quantity").alias("w"))
    got = aggregates.matched_share(rows, ["l_orderkey"], "w", F.col("l_returnflag") != "R")
    share = F.round(F.col("matched").cast("double") * 100 / F.col("total").cast("double"), 1)
    return got.withColumns({"total": F.col("total").cast("double"), "matched": F.col("matched").cast("double"), "share": share}).withColumn(
        "badge", aggregates.badge(F.col("share"))
    )


@query("""WITH w AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2)
SELECT u.user_id, coalesce((SELECT v FROM w WHERE w.user_id = u.user_id AND event_type = 'purchase'), (SELECT v FROM w WHERE w.user_id = u.user_id AND event_type = 'click')) AS first_value,
coalesce((SELECT v FROM w WHERE w.user_id = u.user_id AND event_type = 'signup'), (SELECT v FROM w WHERE w.user_id = u.user_id AND event_type = 'view')) AS other_value
FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN ('purchase','click','signup','view')) u""")
def pivot_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    wanted = {"first_value": ["purchase", "click"], "other_value": ["signup", "view"]}
    return aggregates.first_available(events, "user_id", "event_type", "value", "event_id", wanted)


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) = 1""")
def argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return aggregates.first_best(rows, ["l_orderkey"], F.col("l_extendedprice"), [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).drop(
        "l_partkey", "l_suppkey"
    )


@query("""WITH r AS (SELECT n_nationkey AS id, r_name AS region, CASE WHEN n_nationkey % 3 = 0 THEN 0.6 ELSE 1.0 END AS weight
FROM nation JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT * FROM (VALUES ('AFRICA','EUROPE',0.4),('EUROPE','AFRICA',0.4),('ASIA','EUROPE',0.5),('EUROPE','ASIA',0.5)) t(l, r, link)
UNION ALL SELECT r, r, 0.85 FROM (VALUES ('AFRICA'),('EUROPE'),('ASIA')) s(r))
SELECT a.id AS a, b.id AS b, round(max(a.weight::DOUBLE * b.weight::DOUBLE * link::DOUBLE), 6) AS affinity FROM r a JOIN k ON a.region = k.l JOIN r b ON b.region = k.r GROUP BY 1, 2""")
def region_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = spark.createDataFrame(
        [("AFRICA", "EUROPE", 0.4), ("EUROPE", "AFRICA", 0.4), ("ASIA", "EUROPE", 0.5), ("EUROPE", "ASIA", 0.5)], "left string, right string, link double"
    )
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = joined.select(
        F.col("n_nationkey").alias("id"), F.col("r_name").alias("region"), F.when(F.col("n_nationkey") % 3 == 0, 0.6).otherwise(1.0).alias("weight")
    )
    return rules.affinity(rows, rows, links).withColumn("affinity", F.round("affinity", 6))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    rows = table(spark, sf_dir, "embeddings")
    return list(rows.orderBy("vec_id").select("embedding").first()[0])


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 4) AS score FROM embeddings, q ORDER BY 2 DESC, 1 DESC LIMIT 40""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 vectors most alike the first one: the limit is the feature."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.semantic(vectors, first_vector(spark, sf_dir)).select("id", "score")


@query("""WITH a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank FROM customer QUALIFY rank < 40),
b AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS rank FROM customer QUALIFY rank < 40)
SELECT id, round(sum(1.0::DOUBLE / (61 + rank)), 12) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of 40, fused: the list lengths are the feature."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_name")

    def top(*order: object) -> DataFrame:
        return c.orderBy(*order).limit(40).withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).select("id", "rank")

    return ranking.fuse([top(F.desc("c_acctbal"), "id"), top("c_name", "id")]).select("id", F.round("score", 12).alias("score"))


_WORDS = r"""(SELECT p_partkey AS id, 5.0 AS weight, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS word FROM part
UNION ALL SELECT p_partkey, 3.0, unnest(regexp_extract_all(lower(p_type), '[a-z0-9]+')) FROM part
UNION ALL SELECT p_partkey, 1.0, unnest(regexp_extract_all(lower(p_brand), '[a-z0-9]+')) FROM part)"""
_TERMS = ["wid", "blue", "small"]
_FIELDS = {"p_name": 5.0, "p_type": 3.0, "p_brand": 1.0}


@query(f"""WITH w AS {_WORDS}, t AS (SELECT unnest({_TERMS!r}) AS term),
b AS (SELECT id, term, max(weight * CASE WHEN word = term THEN 1.0 ELSE 0.8 END) AS best FROM w JOIN t ON word = term OR (starts_with(word, term) AND length(term) >= 3) GROUP BY 1, 2)
SELECT id, round(sum(best)::DOUBLE, 3) AS score FROM b GROUP BY 1 HAVING count(*) = {len(_TERMS)}""")
def lexical_exact_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return search.lexical(docs, _TERMS, None, fuzzy=False, fields=_FIELDS)


@query()
def lexical_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return search.lexical(docs, ["widgett", "smal"], None, fields=_FIELDS)


@query("SELECT w, levenshtein(w, 'ring') AS d FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z0-9]+')) AS w FROM part) WHERE levenshtein(w, 'ring') <= 2")
def fuzzy_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(text.tokens(F.concat_ws(" ", "p_type", "p_name"))).alias("w")).distinct()
    return words.withColumn("d", F.levenshtein("w", F.lit("ring"), 2)).filter("d >= 0")


@query()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two words, and vectors like the first, fused to ten."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    lexical = search.lexical(docs, ["the", "idiot"], 40, fields={"text": 1.0})
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.hybrid(lexical, search.semantic(vectors, first_vector(spark, sf_dir)))


@query("""WITH e AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
c AS (SELECT id, len(w) AS size, len(list_filter(w, lambda x: x = 'idiot')) AS t0, len(list_filter(w, lambda x: x = 'license')) AS t1 FROM e),
s AS (SELECT count(*)::DOUBLE AS docs, avg(size) AS mean, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1 FROM c)
SELECT id, round(ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * size / mean))
 + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score FROM c, s WHERE t0 > 0 OR t1 > 0""")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.bm25(docs, ["idiot", "license"]).withColumn("score", F.round("score", 6))


@query()
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.match_url(F.col("url")).alias("match_url"), urls.import_url(F.col("url")).alias("import_url")
    )


@query("""SELECT regexp_replace(lower(regexp_extract(url, '//([^/?#:]+)', 1)), '^www\\.', '') AS site, count(*) AS n FROM pages GROUP BY 1""")
def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(urls.site(F.col("url")).alias("site")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT item_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
e AS (SELECT id, len(w) AS n, unnest(w) AS word FROM w)
SELECT a.id AS a, b.id AS b, round(count(*) / (a.n + b.n - count(*))::DOUBLE, 9) AS jaccard FROM e a JOIN e b ON a.word = b.word AND a.id < b.id
GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.2 * (a.n + b.n - count(*))""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.tokens(F.col("text")).alias("words"))
    pairs = matching.alike_pairs(items, "words", 20)
    return pairs.select("a", "b", F.round(matching.jaccard_of(F.col("both"), F.col("na"), F.col("nb")), 9).alias("jaccard"))


@query()
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of a nation, matched one to one by the nearest balance, less than 500 apart."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return matching.nearest_one_to_one(c, s, "nation", "balance", 500)


@query("""WITH w AS (SELECT c.conv_id, c.turn, regexp_extract_all(lower(p.text), '[a-z0-9]+') AS s, regexp_extract_all(lower(c.text), '[a-z0-9]+') AS f FROM conversations c
JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1),
e AS (SELECT conv_id, turn, w, sum(s) AS s, sum(1 - s) AS f FROM (SELECT conv_id, turn, unnest(s) AS w, 1 AS s FROM w UNION ALL SELECT conv_id, turn, unnest(f), 0 FROM w) GROUP BY 1, 2, 3),
b AS (SELECT conv_id, turn, sum(s) AS s, sum(f) AS f, sum(least(s, f)) AS both FROM e GROUP BY 1, 2)
SELECT w.conv_id, w.turn, coalesce(b.s, 0)::BIGINT AS n_source, coalesce(b.f, 0)::BIGINT AS n_found, coalesce(b.both, 0)::BIGINT AS "both",
round(CASE WHEN coalesce(b.s + b.f, 0) = 0 THEN 0 ELSE 2.0 * b.both / (b.s + b.f) END, 9)::DOUBLE AS f1 FROM w LEFT JOIN b USING (conv_id, turn)""")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation against the turn before, both whole."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    words = lambda c: F.coalesce(text.tokens(F.col(c)), F.array().cast("array<string>"))
    got = matching.token_overlap(turns.join(before, ["conv_id", "turn"]), ["conv_id", "turn"], words("before"), words("text"))
    return got.withColumn("f1", F.round(matching.f1(F.col("both"), F.col("n_source"), F.col("n_found")), 9))


_SECTIONS = [("moving", ["gear", "wheel", "bolt"]), ("warm", ["hot", "red"]), ("small", ["small", "mini"])]


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'gear|wheel|bolt') THEN 'moving' WHEN regexp_matches(lower(p_name), 'hot|red') THEN 'warm'
WHEN regexp_matches(lower(p_name), 'small|mini') THEN 'small' ELSE 'other' END AS section FROM part""")
def section_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", rules.first_match(F.lower("p_name"), _SECTIONS, "other").alias("section"))


@query("""SELECT doc_id, nullif(regexp_extract(regexp_replace(lower(text), 'licensed under|licence plate', ' ', 'g'), 'licen[cs]e|copyright|idiot|scum'), '') AS reason FROM documents""")
def guard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", rules.guarded(F.col("text"), "licensed under|licence plate", "licen[cs]e|copyright|idiot|scum").alias("reason")
    )


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    old, new = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")
    return history.upsert(old, new, ["user_id"], "at").drop("at")


_OPS = "CASE event_type WHEN 'click' THEN 'check' WHEN 'view' THEN 'uncheck' WHEN 'purchase' THEN 'remove' ELSE 'add' END"


@query(f"""WITH o AS (SELECT user_id AS item, {_OPS} AS op, ts, event_id FROM events),
l AS (SELECT *, max((ts, event_id)) FILTER (WHERE op = 'remove') OVER (PARTITION BY item) AS gone FROM o)
SELECT item, coalesce(arg_max(op, (ts, event_id)) FILTER (WHERE op IN ('check', 'uncheck')) = 'check', false) AS checked, count(*) AS n_ops
FROM l WHERE gone IS NULL OR (ts, event_id) > gone GROUP BY 1""")
def lww_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item"), F.expr(_OPS).alias("op"), F.col("ts").alias("at"), F.col("event_id").alias("seq")
    )
    return history.last_writer(ops).select("item", "checked", "n_ops")


@query("""SELECT user_id AS item, event_type AS tag, arg_max(CASE WHEN (value < 20) = (event_id % 3 <> 0) THEN 'remove' ELSE 'add' END, event_id) = 'add' AS present,
bool_or(value < 20 AND event_id % 3 <> 0) AS rejected FROM events GROUP BY 1, 2""")
def revert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("item"),
        F.col("event_type").alias("tag"),
        F.when(F.col("event_id") % 3 != 0, "add").otherwise("remove").alias("action"),
        (F.col("value") < 20).alias("reverted"),
    )
    return history.revert(log)


@query("""SELECT 'orders without customer' AS "check", count(*) AS bad, count(*) = 0 AS ok FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'lines without part', count(*), count(*) = 0 FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL SELECT 'repeated parts', count(*), count(*) = 0 FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'customers without order', count(*), count(*) = 0 FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)
UNION ALL SELECT 'negative quantity', count(*), count(*) = 0 FROM lineitem WHERE NOT l_quantity >= 0""")
def audit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return rules.audit(
        {
            "orders without customer": t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
            "lines without part": t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left_anti"),
            "repeated parts": t("part").groupBy("p_partkey").count().filter("count > 1"),
            "customers without order": t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
            "negative quantity": t("lineitem").filter("not l_quantity >= 0"),
        }
    )


@query("SELECT doc_id, sha256('model-1' || chr(10) || text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash("model-1", F.col("text")).alias("hash"))


@query("SELECT event_id, (props->>'k')::INT AS k FROM events WHERE coalesce((props->>'k')::INT, 0) >= 50")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter(F.coalesce("k", F.lit(0)) >= 50)


@query("""SELECT event_id, epoch(TIMESTAMP '2024-01-20') - epoch(ts) <= 864000 AS deliver FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND event_type = 'click'""")
def due_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    timers = table(spark, sf_dir, "events").filter("event_type = 'click'").select(
        "event_id", F.col("ts").cast("timestamp").cast("double").alias("ends_at"), F.lit(None).cast("timestamp").alias("sent_at")
    )
    return history.due_timers(timers, 1705708800.0, 864_000).select("event_id", "deliver")


@query("""SELECT o_orderkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (SELECT o_orderkey,
trim(regexp_replace(lower(o_orderpriority || ' ' || o_orderstatus || ' of ' || o_custkey), '[^a-z0-9]+', '-', 'g'), '-') AS base, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) AS n FROM orders)""")
def numbered_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of orders, which name the customer, so that no title holds many of them."""
    base = text.slug(F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.lit("of"), "o_custkey"))
    return ranking.numbered_slugs(table(spark, sf_dir, "orders").select("o_orderkey", base.alias("base")), "base", "o_orderkey").drop("base")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM lineitem""")
def section_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return ranking.islands(rows, ["l_orderkey"], [F.col(c) for c in rows.columns[1:]], F.col("l_returnflag") == "N").drop("l_returnflag")


@query("""SELECT conv_id, text AS last_text, length(text) AS n FROM conversations WHERE text IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1""")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("text is not null")
    got = ranking.keep_first(rows, ["conv_id"], [F.desc("turn"), F.desc("text")])
    return got.select("conv_id", F.col("text").alias("last_text"), F.length("text").cast("long").alias("n"))


@query("""SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'add' ELSE 'remove' END AS change
FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') b
ON a.o_custkey = b.o_custkey WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return history.difference(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"), ["o_custkey"])


@query("SELECT p_partkey, p_brand, p_retailprice FROM part QUALIFY p_retailprice >= 0.99 * max(p_retailprice) OVER (PARTITION BY p_brand)")
def near_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.near_best(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", 0.99)


@query("""SELECT user_id AS item, event_type AS kind, event_id::VARCHAR AS value, value / 100 AS confidence FROM events WHERE value / 100 >= 0.6
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value / 100 DESC, event_id::VARCHAR) <= CASE event_type WHEN 'click' THEN 4 WHEN 'view' THEN 2 ELSE 1 END""")
def capped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("value"), (F.col("value") / 100).alias("confidence")
    )
    kinds = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect()]  # a few event types
    return rules.capped_tags(tags, {k: {"click": 4, "view": 2}.get(k, 1) for k in kinds})


@query("""WITH l AS (SELECT p_partkey, p_size // 4 AS w, p_size % 4 AS f, CASE p_type WHEN 'SMALL' THEN 'tsp.' WHEN 'LARGE' THEN 'cups' WHEN 'PROMO' THEN 'lb' WHEN 'MEDIUM' THEN 'cloves' ELSE 'big' END AS u, p_name FROM part)
SELECT p_partkey, CASE WHEN w = 0 AND f = 0 THEN NULL ELSE w + f / 4 END::DOUBLE AS quantity, CASE WHEN w = 0 AND f = 0 THEN NULL ELSE CASE u WHEN 'tsp.' THEN 'tsp' WHEN 'cloves' THEN 'clove' WHEN 'big' THEN NULL ELSE u END END AS unit,
CASE WHEN u = 'big' THEN 'big ' ELSE '' END || p_name AS food,
round((CASE WHEN w = 0 AND f = 0 THEN NULL ELSE w + f / 4 END * CASE u WHEN 'tsp.' THEN 4.929 WHEN 'cups' THEN 236.59 WHEN 'lb' THEN 453.59 ELSE 1 END)::DOUBLE, 4) AS base FROM l""")
def quantity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as ingredient lines: quarters of their size, a unit by their type, their name and a remark."""
    whole, part = F.floor(F.col("p_size") / 4), F.col("p_size") % 4
    shown = F.concat_ws(" ", F.when(whole > 0, whole.cast("string")), amounts.lookup({1: "1/4", 2: "½", 3: "3/4"}, part))
    unit = F.coalesce(amounts.lookup({"SMALL": "tsp.", "LARGE": "cups", "PROMO": "lb", "MEDIUM": "cloves"}, F.col("p_type")), F.lit("big"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(shown, F.lit(" "), unit, F.lit(" "), F.col("p_name"), F.lit(", divided")).alias("line"))
    rows = rows.withColumn("p", amounts.parse_amount(F.col("line")))
    base = F.round(F.col("p.quantity") * amounts.family(F.col("p.unit"))["per"], 4)
    return rows.select("p_partkey", "p.quantity", "p.unit", amounts.food_key(F.col("line")).alias("food"), base.alias("base"))


@query("""SELECT o_orderkey, CASE WHEN m > 0 THEN m END::INT AS minutes FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 30) * 60 + o_orderkey % 60
WHEN 1 THEN (o_custkey % 30) * 60 + o_orderkey % 60 WHEN 2 THEN (o_custkey % 9) * 1440 END AS m FROM orders)""")
def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of orders as durations: ISO 8601, words, days, and a text that is none."""
    h, m = (F.col("o_custkey") % 30).cast("string"), (F.col("o_orderkey") % 60).cast("string")
    said = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("PT"), h, F.lit("H"), m, F.lit("M")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(h, F.lit(" hrs "), m, F.lit(" minutes")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("P"), (F.col("o_custkey") % 9).cast("string"), F.lit("D")))
        .otherwise(F.lit("overnight"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", durations.duration_minutes(said).alias("minutes"))


@query("""WITH l AS (SELECT conv_id AS id, role AS title, trim(unnest(string_split(lower(text), chr(10))), chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS key FROM conversations),
s AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+')) AS w FROM documents),
k AS (SELECT DISTINCT key FROM l), w AS (SELECT key, unnest(regexp_split_to_array(key, '[\\x20\\x09-\\x0D]+')) AS w FROM k),
h AS (SELECT key FROM w SEMI JOIN s USING (w) WHERE w <> '' UNION SELECT key FROM k WHERE key IN ('', 'water', 'ice')),
d AS (SELECT DISTINCT id, title, key, key IN (SELECT key FROM h) AS have FROM l)
SELECT id, title, count(*) FILTER (WHERE NOT have) AS to_buy_count, round_even(count(*) FILTER (WHERE NOT have) * 100.0 / count(*), 0)::INT AS percent_to_buy FROM d GROUP BY 1, 2""")
def staple_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as recipes, the lines of their turns as lines, against all words of the documents as staples."""
    line = F.explode(F.split(F.lower("text"), "\n", -1))
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("title"), line.alias("key"))
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("name"))
    lines = lines.withColumn("key", F.regexp_replace("key", r"^\s+|\s+$", ""))
    staples = words.filter("name <> ''").distinct()
    return coverage.coverage(lines, staples)


@query("""SELECT s.s_suppkey AS a, c.c_custkey AS b, CASE WHEN s.s_suppkey IS NULL THEN 'b' WHEN c.c_custkey IS NULL THEN 'a' ELSE 'both' END AS source,
coalesce(s.s_name, c.c_name) AS name, least(s.s_acctbal, c.c_acctbal) AS low, greatest(s.s_acctbal, c.c_acctbal) AS high
FROM supplier s FULL JOIN customer c ON split_part(s.s_name, '#', 2) = split_part(c.c_name, '#', 2) AND s.s_nationkey % 5 = c.c_nationkey % 5""")
def record_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers and all customers, those of one number and region as one record."""
    number = lambda c: F.element_at(F.split(c, "#"), 2).alias("number")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), number("s_name"), (F.col("s_nationkey") % 5).alias("r"), F.col("s_acctbal").alias("low"), F.col("s_acctbal").alias("high"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), number("c_name"), (F.col("c_nationkey") % 5).alias("r"), F.col("c_acctbal").alias("low"), F.col("c_acctbal").alias("high"))
    pairs = s.select(F.col("id").alias("a"), "number", "r").join(c.select(F.col("id").alias("b"), "number", "r"), ["number", "r"]).select("a", "b")
    return matching.fused(s, c, pairs, ["name"], ["low"], ["high"])


@query("""SELECT o_orderkey, CASE WHEN n IS NULL THEN 'empty' WHEN o_orderstatus = 'F' THEN 'done' WHEN n >= 5 THEN 'large' ELSE 'open' END AS outcome
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def row_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    cascade = [("empty", F.col("n").isNull()), ("done", F.col("o_orderstatus") == "F"), ("large", F.col("n") >= 5)]
    return rules.ledger(orders, lines, "o_orderkey", cascade, "open")


@query("""SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'A') THEN 0 ELSE 1 END AS tier,
arg_max(l_orderkey * 10 + l_linenumber, ((CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END), l_extendedprice, l_orderkey * 10 + l_linenumber)) AS line
FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1""")
def tiered_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice", line)
    tiers = [F.col("l_returnflag") == "A", F.col("l_returnflag") == "R"]
    return ranking.first_tier(rows, "l_partkey", tiers, [F.desc("l_extendedprice"), F.desc("line")]).select("l_partkey", "tier", "line")


@query("""SELECT user_id, arg_max(value, event_id) AS value, min(event_id) AS event_id FROM events GROUP BY user_id, event_type""")
def keep_last_first_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return ranking.keep_last_in_first_place(rows, ["user_id", "event_type"], "event_id").drop("event_type")


@query("""SELECT c_nationkey, string_agg(kind || '=' || names, ';' ORDER BY kind) AS tags FROM (SELECT c_nationkey, c_mktsegment AS kind,
string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS names FROM customer GROUP BY 1, 2) GROUP BY 1""")
def nested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("kind")).agg(
        F.array_join(F.sort_array(F.collect_list("c_custkey")).cast("array<string>"), ",").alias("names")
    )
    pair = F.concat(F.col("kind"), F.lit("="), F.col("names"))
    return inner.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list(pair)), ";").alias("tags"))


@query("""SELECT event_id, user_id, value FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE value > 90) AND event_type ILIKE 'CL%'
AND (value BETWEEN 10 AND 60 OR user_id IN (1, 2, 3))""")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    high = events.filter("value > 90").select("event_id")
    kept = events.filter(F.ilike("event_type", F.lit("CL%")) & (F.col("value").between(10, 60) | F.col("user_id").isin(1, 2, 3)))
    return kept.join(high, "event_id", "left_anti").select("event_id", "user_id", "value")


@query("""SELECT c.conv_id, c.turn, coalesce(nullif(c.role, ''), 'none') AS who, length(c.text) - length(p.text) AS change FROM conversations c
LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def turn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    change = F.length("text") - F.length(before)
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.coalesce(F.nullif("role", F.lit("")), F.lit("none")).alias("who"), change.cast("long").alias("change"))


@query("""SELECT p_brand, avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) AS share, count(*) FILTER (WHERE abs(p_retailprice - 950) / 950 * 100 <= 2) AS within FROM part GROUP BY 1""")
def agreement_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.abs(F.col("p_retailprice") - 950) / 950 * 100 <= 2
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.avg((F.col("p_size") > 25).cast("double")).alias("share"), F.count_if(near).alias("within")
    )
