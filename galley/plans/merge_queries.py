"""Queries for merges and nested documents: tags with a log, records with collections, documents that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators import merging, validity
from galley.plans.catalog_queries import query
from galley.sources.tables import table

_KIND = "CASE l_linenumber % 4 WHEN 0 THEN 'cuisine' WHEN 1 THEN 'course' WHEN 2 THEN 'protein' ELSE 'diet' END"
_VALUE = "CASE WHEN l_suppkey % 6 = 0 THEN 'none' WHEN l_suppkey % 6 = 1 THEN 'Asian' ELSE concat('v', l_suppkey % 6) END"
_PLACE = "l_orderkey * 10 + l_linenumber"
_SOURCE = "CASE l_partkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'migrated' ELSE 'manual' END"


@query(f"""
WITH l AS (SELECT l_partkey AS item, {_KIND} AS kind, {_VALUE} AS value, {_PLACE} AS place, l_orderkey, 0.5 + l_tax * 6 AS confidence, l_discount, l_quantity, {_SOURCE} AS source FROM lineitem),
c AS (SELECT item, kind, value, confidence, place FROM l WHERE l_quantity > 30 AND round(confidence, 9) >= 0.6),
p0 AS (SELECT *, row_number() OVER (PARTITION BY item, kind ORDER BY round(confidence, 9) DESC, place) AS n FROM c QUALIFY n <= CASE kind WHEN 'diet' THEN 4 ELSE 2 END),
p1 AS (SELECT * FROM p0 QUALIFY NOT (kind = 'protein' AND value = 'none' AND bool_or(value <> 'none') OVER (PARTITION BY item, kind))),
p AS (SELECT item, kind, value, arg_max(round(confidence, 9), n) AS confidence, arg_max(place, n) AS place FROM p1 GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT item, kind FROM p),
s AS (SELECT item, kind, value, min(source) AS source FROM l WHERE l_discount = 0.05 GROUP BY 1, 2, 3),
r AS (SELECT DISTINCT item, kind, value FROM l WHERE l_discount = 0.03),
g AS (SELECT item, value, min('line ' || place) AS reason FROM l WHERE l_discount = 0.01 AND kind = 'diet' GROUP BY 1, 2),
a AS (SELECT item, kind, value FROM p UNION SELECT item, kind, value FROM s UNION SELECT item, kind, value FROM r),
f AS (SELECT a.*, p.item IS NOT NULL AS is_p, s.item IS NOT NULL AS is_s, r.item IS NOT NULL AS is_r, g.item IS NOT NULL AS is_g, g.reason, s.source, p.confidence, p.place,
  s.source = 'auto' AND p.item IS NULL AND (a.kind = 'diet' OR k.item IS NOT NULL OR (a.kind = 'cuisine' AND lower(a.value) = 'asian')) AS old
  FROM a LEFT JOIN p USING (item, kind, value) LEFT JOIN s USING (item, kind, value) LEFT JOIN r USING (item, kind, value)
  LEFT JOIN g ON a.item = g.item AND a.kind = 'diet' AND a.value = g.value LEFT JOIN k ON k.item = a.item AND k.kind = a.kind),
t AS (SELECT *, is_p AND NOT is_s AND NOT is_r AND NOT is_g AS new FROM f)
SELECT item, kind, value, CASE WHEN new THEN 'added' WHEN is_s AND is_g THEN 'guarded' WHEN old THEN 'superseded' WHEN is_s THEN 'stands' WHEN is_p THEN 'refused' ELSE 'rejected' END AS state,
  CASE WHEN is_s THEN source WHEN new THEN 'auto' END AS source, CASE WHEN NOT is_s THEN round(confidence, 2) END AS confidence,
  concat_ws('|', CASE WHEN new THEN '+' || value || ': line ' || place END, CASE WHEN old THEN '-' || value || ': not confirmed' END, CASE WHEN is_s AND is_g THEN '-' || value || ': diet guard: ' || reason END) AS log
FROM t""")
def merged_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of parts; lines propose, have set, have rejected and forbid them."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item"), F.expr(_KIND).alias("kind"), F.expr(_VALUE).alias("value"), F.expr(_PLACE).alias("place"),
        F.round(0.5 + F.col("l_tax") * 6, 9).alias("confidence"), "l_discount", "l_quantity", F.expr(_SOURCE).alias("source"),
    )
    said = F.concat(F.lit("line "), F.col("place").cast("string"))
    proposed = line.filter("l_quantity > 30").withColumn("evidence", said)
    standing = line.filter("l_discount = 0.05").select("item", "kind", "value", "source", F.lit(None).cast("string").alias("evidence"))
    rejected, forbidden = line.filter("l_discount = 0.03"), line.filter("l_discount = 0.01 and kind = 'diet'").withColumn("reason", said)
    got = merging.merged_tags(proposed, standing, rejected, forbidden)
    sign = lambda x: F.concat(F.when(x["after"].isNotNull(), F.concat(F.lit("+"), x["after"])).otherwise(F.concat(F.lit("-"), x["before"])), F.lit(": "), x["reason"])
    return got.select("item", "kind", "value", "state", "source", "confidence", F.array_join(F.transform("log", sign), "|").alias("log"))


@query("""
WITH m AS (SELECT s_suppkey AS id, 'a' AS side, split_part(s_name, '#', 2) || '/' || s_nationkey % 5 AS record FROM supplier
  UNION ALL SELECT c_custkey, 'b', split_part(c_name, '#', 2) || '/' || c_nationkey % 5 FROM customer),
t AS (SELECT 'a' AS side, l_suppkey AS id, l_orderkey * 10 + l_linenumber AS place, l_returnflag AS kind, l_linestatus AS value, l_quantity::INT::VARCHAR AS evidence FROM lineitem
  UNION ALL SELECT 'b', o_custkey, o_orderkey, o_orderstatus, left(o_orderpriority, 1), 'order ' || o_orderkey FROM orders),
e AS (SELECT record, kind, value, list_reduce(list(evidence ORDER BY side, place, evidence), lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || '; ' || x END) AS evidence FROM t JOIN m USING (side, id) GROUP BY 1, 2, 3),
i AS (SELECT 'a' AS side, l_suppkey AS id, l_orderkey * 10 + l_linenumber AS place, l_orderkey * 10 + l_linenumber AS image, l_linenumber = 1 AS main, l_discount > 0.07 AS generated, true AS present FROM lineitem WHERE l_quantity < 4
  UNION ALL SELECT 'b', o_custkey, o_orderkey, o_orderkey, true, o_orderstatus = 'P', o_totalprice > 50000 FROM orders WHERE o_orderkey % 3 = 0),
f AS (SELECT DISTINCT * FROM i JOIN m USING (side, id)),
c AS (SELECT record, arg_min((side, image), (side, place, image)) AS first FROM f WHERE NOT generated AND CASE side WHEN 'a' THEN main ELSE present END GROUP BY 1),
r AS (SELECT f.*, CASE WHEN side = 'b' AND NOT present THEN 'missing' WHEN generated THEN 'generated' WHEN (side, image) IS NOT DISTINCT FROM first THEN 'primary' WHEN side = 'a' AND NOT main THEN 'step' ELSE 'extra' END AS role FROM f LEFT JOIN c USING (record)),
p AS (SELECT record, string_agg(side || image || ' ' || role, ',' ORDER BY side, NOT main, place, image) FILTER (WHERE role IN ('primary', 'step')) AS images, count(*) FILTER (WHERE role = 'missing') AS missing,
  count(*) FILTER (WHERE role = 'generated') AS generated, count(*) FILTER (WHERE role = 'extra') AS extra FROM r GROUP BY 1),
v AS (SELECT record, min(since) AS favourite FROM (SELECT 'a' AS side, l_suppkey AS id, l_shipdate AS since FROM lineitem WHERE l_quantity = 50 UNION ALL SELECT 'b', o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT') JOIN m USING (side, id) GROUP BY 1),
g AS (SELECT record, string_agg(kind || value || ': ' || evidence, '|' ORDER BY kind, value) AS tags FROM e GROUP BY 1)
SELECT record, coalesce(tags, '') AS tags, coalesce(images, '') AS images, coalesce(missing, 0) AS missing, coalesce(generated, 0) AS generated, coalesce(extra, 0) AS extra, favourite
FROM (SELECT DISTINCT record FROM m) LEFT JOIN g USING (record) LEFT JOIN p USING (record) LEFT JOIN v USING (record)""")
def fused_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers of one number and region as one record, with tags and pictures from their lines and orders."""
    s, c, lines, orders = (table(spark, sf_dir, t) for t in ("supplier", "customer", "lineitem", "orders"))
    name = lambda n, k: F.concat_ws("/", F.element_at(F.split(n, "#"), 2), (F.col(k) % 5).cast("string")).alias("record")
    side = lambda x: F.lit(x).alias("side")
    members = s.select(F.col("s_suppkey").alias("id"), side("a"), name("s_name", "s_nationkey")).unionByName(c.select(F.col("c_custkey").alias("id"), side("b"), name("c_name", "c_nationkey")))
    place = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    number = F.col("l_quantity").cast("int").cast("string")
    tags = lines.select(side("a"), F.col("l_suppkey").alias("id"), place.alias("place"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("value"), number.alias("evidence"))
    text = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    order = F.col("o_orderkey").cast("long")
    tags = tags.unionByName(orders.select(side("b"), F.col("o_custkey").alias("id"), order.alias("place"), F.col("o_orderstatus").alias("kind"), F.left("o_orderpriority", F.lit(1)).alias("value"), text.alias("evidence")))
    flag = lambda x, n: x.alias(n)
    images = lines.filter("l_quantity < 4").select(
        side("a"), F.col("l_suppkey").alias("id"), place.alias("place"), place.alias("image"), flag(F.col("l_linenumber") == 1, "main"), flag(F.col("l_discount") > 0.07, "generated"), flag(F.lit(True), "present")
    )
    images = images.unionByName(orders.filter("o_orderkey % 3 = 0").select(
        side("b"), F.col("o_custkey").alias("id"), order.alias("place"), order.alias("image"), flag(F.lit(True), "main"), flag(F.col("o_orderstatus") == "P", "generated"), flag(F.col("o_totalprice") > 50000, "present")
    )).distinct()
    favourites = lines.filter("l_quantity = 50").select(side("a"), F.col("l_suppkey").alias("id"), F.col("l_shipdate").alias("at"))
    favourites = favourites.unionByName(orders.filter("o_orderpriority = '1-URGENT'").select(side("b"), F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at")))
    got = merging.fused_collections(members, tags, images, favourites)
    many = lambda role: F.size(F.filter("left_out", lambda x: x["role"] == role)).cast("long").alias(role)
    return got.select(
        "record",
        F.array_join(F.transform("tags", lambda t: F.concat(t["kind"], t["value"], F.lit(": "), t["evidence"])), "|").alias("tags"),
        F.array_join(F.transform("images", lambda i: F.concat(i["side"], i["image"].cast("string"), F.lit(" "), i["role"])), ",").alias("images"),
        many("missing"), many("generated"), many("extra"), "favourite",
    )


@query("""
WITH l AS (SELECT l_orderkey AS doc, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
d AS (SELECT doc, doc % 10 AS form, max(n) AS n, count(DISTINCT l_linenumber) AS ids, arg_min(l_linenumber, place) AS first, arg_max(l_linenumber, place) AS last FROM l GROUP BY 1),
r AS (SELECT doc, l_linenumber, row_number() OVER (PARTITION BY doc, l_linenumber ORDER BY place) AS nth FROM l)
SELECT doc, 'repeated ingredient' AS rule, 's1' AS section, 'i' || l_linenumber AS id FROM r WHERE nth > 1
UNION ALL SELECT doc, 'length of title', NULL, NULL FROM d WHERE form = 0
UNION ALL SELECT doc, 'unknown line', 's1', 'a1' FROM d WHERE form = 1
UNION ALL SELECT doc, 'reversed span', 's1', 'a1' FROM d WHERE form = 2 AND first < last
UNION ALL SELECT doc, 'repeated action', 's1', 'a1' FROM d WHERE form = 3
UNION ALL SELECT doc, 'id', 's1', '-x' FROM d WHERE form = 4
UNION ALL SELECT doc, 'sequence', 's1', 'a1' FROM d WHERE form = 5
UNION ALL SELECT doc, 'number of instructions sections', NULL, NULL FROM d WHERE form = 6
UNION ALL SELECT doc, 'repeated section', 's1', 's1' FROM d WHERE form = 7
UNION ALL SELECT doc, 'length of step', 's2', 'p1' FROM d WHERE form = 8""")
def invalid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: each order as a document of its lines, in one of ten forms, nine of which break a rule; lines with one number break one too."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(rows.alias("l"))
    form = F.col("doc") % 10
    version = F.when(form >= 6, 2).otherwise(1)
    name = lambda x: F.concat(F.lit("i"), x["l_linenumber"].cast("string"))
    lines = F.transform("l", lambda x: F.struct(name(x).alias("id"), F.concat(x["l_partkey"].cast("string"), F.lit(" g")).alias("text")))
    first, last = name(F.element_at("l", 1)), name(F.element_at("l", -1))
    action = lambda a: F.struct(
        F.lit(a).alias("id"), F.lit("mix").alias("label"), F.when(form == 5, -1).otherwise(3).alias("sequence"),
        F.when(form == 1, "i99").when(form == 2, last).otherwise(first).alias("start"), F.when(form == 2, first).otherwise(last).alias("end"),
    )
    one = F.array(action("a1"))
    actions = F.when(form == 3, F.array(action("a1"), action("a1"))).when(form == 4, F.array(action("a1"), action("-x"))).otherwise(one)
    none_of = lambda a: F.slice(a, 1, 0)
    step = F.array(F.struct(F.lit("p1").alias("id"), F.when(form == 8, " ").otherwise("Mix it.").alias("text")))
    section = lambda i, kind, ingredients, steps, acts: F.struct(
        F.lit(i).alias("id"), F.lit("Part").alias("heading"), F.lit(kind).alias("kind"), ingredients.alias("ingredients"), steps.alias("steps"), acts.alias("actions")
    )
    listed = section("s1", "ingredients", lines, none_of(step), none_of(one))
    told = lambda i: section(i, "instructions", none_of(lines), step, none_of(one))
    sections = (
        F.when(version == 1, F.array(section("s1", "table", lines, none_of(step), actions))).when(form == 6, F.array(listed)).when(form == 7, F.array(listed, told("s1"))).otherwise(F.array(listed, told("s2")))
    )
    docs = docs.select("doc", version.alias("version"), F.when(form != 0, "Stew").alias("title"), F.lit("4").alias("yield_text"), F.array(F.lit("note")).alias("notes"), sections.alias("sections"))
    return validity.breaches(docs, "doc")
