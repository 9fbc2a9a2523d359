import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def oracle(sf):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    for name in names.split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")

    def plain(value):
        return round(float(value), 6) + 0.0 if isinstance(value, float) or type(value).__name__ == "Decimal" else value

    def same(df, sql):
        columns = sorted(df.columns)
        got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
        result = db.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
        assert got == want

    return same
