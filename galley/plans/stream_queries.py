"""Queries that run a table through a stream with state, up to its end, and read what the stream wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.plans.catalog_queries import _OPS, query
from galley.sources.tables import shared_dir
from galley.streaming import keyed


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # A source of files wants a folder or a pattern; this pattern is the table, be it one file or a folder of parts.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """A folder for a stream's results and one for its checkpoint, both shared and new."""
    root = f"{shared_dir(spark)}/galley/{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/state"


@query(f"""WITH o AS (SELECT user_id AS item, {_OPS} AS op, epoch_us(ts) // 1000 AS ts, event_id FROM events),
l AS (SELECT *, max((ts, event_id)) FILTER (WHERE op = 'remove') OVER (PARTITION BY item) AS gone FROM o)
SELECT item, coalesce(arg_max(op, (ts, event_id)) FILTER (WHERE op IN ('check', 'uncheck')) = 'check', false) AS checked, count(*) AS n_ops
FROM l WHERE gone IS NULL OR (ts, event_id) > gone GROUP BY 1""")
def lww_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6 as a stream: the last state that it wrote of each item with live operations."""
    out, state = folders(spark, "lww")
    ops = event_stream(spark, sf_dir).select(F.col("user_id").alias("item"), F.expr(_OPS).alias("op"), "at", F.col("event_id").alias("seq"))
    keyed.run_available(keyed.last_written(ops, "1 day"), keyed.by_batch(out), state, "update")
    last = spark.read.parquet(out).groupBy("item").agg(F.max_by(F.struct("checked", "n_ops"), "batch").alias("s"))
    return last.select(F.col("item").cast("long").alias("item"), "s.*").filter("n_ops > 0")


@query("""
WITH t AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS set_at, epoch_us(ts) // 1000 + (value * 600000)::BIGINT AS ends FROM events),
c AS (SELECT max(set_at) AS clock FROM t)
SELECT user_id, event_id, ends AS ends_ms, clock - ends <= 600000 AS deliver FROM t, c WHERE ends <= clock""")
def timer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 as a stream: a timer for each event, ten minutes for each unit of its value; what has fired when the events end."""
    out, state = folders(spark, "timers")
    events = event_stream(spark, sf_dir)
    at, ends = F.timestamp_millis(F.unix_millis("at")), F.timestamp_millis(F.unix_millis("at") + F.round(F.col("value") * 600_000).cast("long"))
    timers = events.select(F.col("user_id").cast("string").alias("device"), F.col("event_id").cast("string").alias("timer"), at.alias("at"), ends.alias("ends"))
    keyed.run_available(keyed.fired(timers), keyed.by_batch(out), state)
    return spark.read.parquet(out).select(F.col("device").cast("long").alias("user_id"), F.col("timer").cast("long").alias("event_id"), "ends_ms", "deliver")


@query("""SELECT event_id, CASE WHEN value < 20 THEN 'failed' ELSE 'done' END AS status, CASE WHEN value < 20 THEN 'no handler for ' || event_id END AS error,
row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id::VARCHAR)::INT AS place FROM events""")
def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs, in a queue for each type; those of a small value have no handler."""
    out, state = folders(spark, "jobs")
    kind = F.when(F.col("value") < 20, "unknown").otherwise("known")
    jobs = event_stream(spark, sf_dir).select(F.col("event_type").alias("queue"), F.col("event_id").cast("string").alias("job"), "at", kind.alias("payload"))
    keyed.run_available(jobs, keyed.run_jobs(only_known, out), state)
    return spark.read.parquet(out).select(F.col("job").cast("long").alias("event_id"), "status", "error", "place")


def only_known(job: str, payload: str) -> None:
    if payload != "known":
        raise RuntimeError(f"no handler for {job}")
