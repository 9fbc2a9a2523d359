import pytest

from galley.plans import kitchen_queries, merge_queries, recipe_queries, stream_queries  # noqa: F401  (they register their queries)
from galley.plans.catalog_queries import ORACLE_SQL, QUERIES

FULL = {"canonical_url": 50, "duplicate_finder": 1, "greedy_match": 1, "hybrid_search": 1, "inbox_states": 1, "lexical_fuzzy": 1, "line_recall": 1}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, sf, oracle):
    oracle(QUERIES[name](spark, sf), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(name, spark, sf):
    assert QUERIES[name](spark, sf).count() >= FULL[name]


def test_greedy_match_against_plain_python(spark, sf):
    """The pairs in one strict order, each taken unless one of its sides is."""
    c = spark.read.parquet(f"{sf}/customer.parquet").collect()
    s = spark.read.parquet(f"{sf}/supplier.parquet").collect()
    near = [(abs(x["c_acctbal"] - y["s_acctbal"]), x["c_custkey"], y["s_suppkey"]) for x in c for y in s if x["c_nationkey"] == y["s_nationkey"]]
    want, used = set(), set()
    for apart, a, b in sorted(p for p in near if p[0] < 500):
        if ("a", a) not in used and ("b", b) not in used:
            want.add((a, b))
            used |= {("a", a), ("b", b)}
    assert {(r["a"], r["b"]) for r in QUERIES["greedy_match"](spark, sf).collect()} == want


def test_canonical_urls_against_plain_python(spark, sf):
    from urllib.parse import urlsplit

    from galley.functions import urls

    found = {r["page_id"]: r["match_url"] for r in QUERIES["canonical_url"](spark, sf).collect()}
    for page in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect():
        parts = urlsplit(page["url"])
        kept = sorted(p for p in parts.query.split("&") if p and p.split("=")[0].lower() not in urls.MATCH_PARAMETERS and not p.lower().startswith(urls.MATCH_PREFIXES))
        want = f"https://{parts.hostname.removeprefix('www.')}{parts.path.rstrip('/')}" + (f"?{'&'.join(kept)}" if kept else "")
        assert found[page["page_id"]] == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def written(folder, **tables):
    """A folder with tables that SQL gives."""
    import duckdb

    for name, sql in tables.items():
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def agrees(spark, name, folder, **tables):
    """Whether a query gives what its SQL gives on these tables."""
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    written(folder, **tables)
    for other in tables:
        db.execute(f"CREATE VIEW {other} AS SELECT * FROM '{folder}/{other}.parquet'")
    got = QUERIES[name](spark, str(folder))
    result = db.execute(ORACLE_SQL[name])
    assert sorted(map(tuple, got.select(*[d[0] for d in result.description]).collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_timers_end_within_a_second(spark, tmp_path):
    """Ends half a second behind the moment, and half a second beyond what is still delivered."""
    times = "(0, TIMESTAMP '2024-01-20 00:00:00.5'), (1, TIMESTAMP '2024-01-19 23:59:59.5'), (2, TIMESTAMP '2024-01-09 23:59:59.5'), (3, TIMESTAMP '2024-01-10 00:00:00')"
    agrees(spark, "due_timers", tmp_path, events=f"SELECT k::BIGINT AS event_id, ts, 'click' AS event_type FROM (VALUES {times}) t(k, ts)")


def test_publisher_value_on_half_a_cent(spark, tmp_path):
    """A price on half a cent is rounded as the double says, and so are the kilojoules made of it."""
    orders = "SELECT k::BIGINT AS o_orderkey, p::DOUBLE AS o_totalprice FROM (VALUES (99869, 216082.5), (5, 216083.5), (8, 100.5), (2, 3.5), (3, 1)) t(k, p)"
    lines = "SELECT k::BIGINT AS l_orderkey, 7::DOUBLE AS l_quantity, 2 AS l_linenumber FROM (VALUES (99869), (5), (8), (2), (3)) t(k)"
    agrees(spark, "publisher_first", tmp_path, orders=orders, lineitem=lines)
