import pytest

from galley.sources.tables import drop_materialised, materialise


def test_written_table_outlives_its_source(spark):
    df = spark.range(5).selectExpr("id", "rand() as r")
    kept = materialise(df, "test")
    assert kept.collect() == kept.collect() and kept.columns == df.columns
    path = kept.inputFiles()[0].removeprefix("file://")
    drop_materialised(spark)
    import os

    assert not os.path.exists(path)


def test_a_table_is_replaced_as_a_whole(spark, tmp_path):
    from galley.sources.tables import publish, published

    root = f"file://{tmp_path}/t"
    publish(spark.range(10).withColumnRenamed("id", "a"), root)
    first = published(spark, root)
    publish(spark.range(3).withColumnRenamed("id", "b"), root)
    assert first.count() == 10 and first.columns == ["a"]
    assert published(spark, root).count() == 3 and published(spark, root).columns == ["b"]
    broken = spark.range(5).selectExpr("assert_true(id < 3) as x", "id")
    with pytest.raises(Exception):  # noqa: B017  (what Spark raises from a failed write)
        publish(broken, root)
    assert published(spark, root).columns == ["b"]


def test_another_database_by_ranges(spark):
    """The embedded database that comes with Spark."""
    from pyspark.sql import functions as F

    from galley.sources.documents import jdbc_ranges, key_ranges

    url = "jdbc:derby:memory:galley;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1000).select(F.when(F.col("id") % 100 != 7, F.col("id") * 3 - 900).alias("id"), F.col("id").cast("int").alias("at"), F.col("id").cast("string").alias("name"))
    rows.write.jdbc(url, "items", mode="overwrite", properties=options)
    got = jdbc_ranges(spark, url, "items", "id", 7, {"name": "int"}, properties=options)
    assert got.rdd.getNumPartitions() == 7 and dict(got.dtypes)["name"] == "int"
    assert sorted(r["name"] for r in got.collect()) == list(range(1000))
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 200
    bound = jdbc_ranges(spark, url, "items", "id", 4, until=("at", "499"), properties=options)
    assert bound.count() == 500 and bound.rdd.getNumPartitions() == 4
    assert jdbc_ranges(spark, url, "items", "id", 4, until=("at", "-1"), properties=options).count() == 0
    assert key_ranges("k", None, None, 5) == key_ranges("k", 3, 3, 5) == key_ranges("k", 1, 9, 1) == ["1 = 1"]
    assert key_ranges("k", 0, 9, 3) == ["k < 3 OR k IS NULL", "k >= 3 AND k < 6", "k >= 6"]
