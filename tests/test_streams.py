"""Streams in several batches, with restarts and out of order, against the batch functions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from galley.operators import history
from galley.streaming import keyed

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def write(spark, folder, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)


TIMER = "device string, timer string, at timestamp, ends timestamp"


def test_timers_fire_once_across_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(rows):
        """Each call starts the query anew from its checkpoint."""
        write(spark, source, rows, TIMER)
        stream = spark.readStream.schema(TIMER).parquet(source)
        keyed.run_available(keyed.fired(stream), keyed.by_batch(out), state)
        return sorted((r["device"], r["timer"], r["deliver"]) for r in spark.read.parquet(out).collect())

    clock = lambda s: ("clock", f"tick{s}", at(s), None)
    first = [("d1", "eggs", at(0), at(300)), ("d1", "rice", at(0), at(900)), ("d2", "eggs", at(1), at(300)), ("d2", "tea", at(2), at(240)), ("d2", "tea", at(5), None)]
    assert run([*first, clock(10)]) == []
    assert run([("d1", "rice", at(20), at(2000)), clock(320)]) == [("d1", "eggs", True), ("d2", "eggs", True)]
    assert run([clock(330)]) == [("d1", "eggs", True), ("d2", "eggs", True)]
    late = run([clock(2601)])  # the set time has passed by more than ten minutes
    assert late == [("d1", "eggs", True), ("d1", "rice", False), ("d2", "eggs", True)]
    again = run([("d1", "eggs", at(2610), at(2620)), clock(2700)])
    assert again.count(("d1", "eggs", True)) == 2 and len(again) == 4
    assert run([clock(200_000)]) == again  # forgotten a day later, without another delivery

    timers = spark.createDataFrame([("d1/eggs", 300.0, None), ("d2/eggs", 300.0, None), ("d1/rice", 2000.0, None)], "id string, ends_at double, sent_at double")
    batch = {r["id"]: r["deliver"] for r in history.due_timers(timers, 320.0).collect()} | {r["id"]: r["deliver"] for r in history.due_timers(timers.filter("ends_at > 300"), 2601.0).collect()}
    assert batch == {"d1/eggs": True, "d2/eggs": True, "d1/rice": False}


def test_many_timers_in_few_groups(spark, tmp_path):
    """Timers of one group end at different times, are set again and cancelled, each for itself; calls are for groups, not timers."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(rows):
        write(spark, source, rows, TIMER)
        keyed.run_available(keyed.fired(spark.readStream.schema(TIMER).parquet(source), groups=3), keyed.by_batch(out), state)
        return sorted((r["device"], r["timer"], r["deliver"]) for r in spark.read.parquet(out).collect())

    timers = [(f"d{k % 7}", f"t{k}", at(0), at(100 + k)) for k in range(2000)]
    assert len(run([*timers, ("clock", "a", at(1099), None)])) == 1000
    first = [(d, t, (1099 - 100 - k) <= 600) for k, (d, t, _, _) in enumerate(timers[:1000])]
    run([("d0", "t1001", at(1100), None), ("d0", "t1400", at(1100), at(5000)), ("d3", "t1004", at(1100), None), ("clock", "b", at(1199), None)])
    got = run([("clock", "c", at(2200), None)])
    want = first + [(d, t, None) for k, (d, t, _, _) in enumerate(timers) if k >= 1000 and t not in ("t1001", "t1400", "t1004")]
    assert [x[:2] for x in got] == sorted(x[:2] for x in want) and set(first) <= set(got)


OPS = "item string, op string, at timestamp, seq long"


def final(spark, out):
    rows = spark.read.parquet(out).groupBy("item").agg(F.max_by(F.struct("checked", "n_ops", "at_ms"), "batch").alias("s"))
    return {r["item"]: tuple(r["s"]) for r in rows.collect() if r["s"]["n_ops"]}


def test_any_order_gives_the_batch_result(spark, tmp_path):
    rng = random.Random(6)
    ops = [(rng.choice("abcdef"), rng.choice(["check", "uncheck", "add", "remove"]), at(rng.randrange(600)), k) for k in range(160)]
    batch = history.last_writer(spark.createDataFrame(ops, OPS)).collect()
    want = {r["item"]: (r["checked"], r["n_ops"], int((r["at"] - START).total_seconds())) for r in batch}
    for order in range(2):
        rng.shuffle(ops)
        source, out, state = (str(tmp_path / f"{x}{order}") for x in ("in", "out", "state"))
        for k in range(0, 160, 55):
            write(spark, source, ops[k : k + 55] + ops[k : k + 3], OPS)  # some arrive twice
            stream = spark.readStream.schema(OPS).parquet(source)
            keyed.run_available(keyed.last_written(stream, "1 hour"), keyed.by_batch(out), state, "update")
        epoch = int(spark.sql(f"select unix_millis(timestamp'{START}')").first()[0])
        got = {i: (c, n, (t - epoch) // 1000) for i, (c, n, t) in final(spark, out).items()}
        assert got == want


def test_operations_behind_the_watermark(spark, tmp_path):
    """What the watermark has passed is kept as a sum; a late operation is dropped, a removal in time takes all before it."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(rows):
        write(spark, source, rows, OPS)
        keyed.run_available(keyed.last_written(spark.readStream.schema(OPS).parquet(source), "10 seconds"), keyed.by_batch(out), state, "update")
        return {i: s[:2] for i, s in final(spark, out).items()}

    assert run([("a", "add", at(0), 1), ("a", "check", at(1), 2), ("b", "check", at(100), 3)]) == {"a": (True, 2), "b": (True, 1)}
    assert run([("a", "uncheck", at(95), 4), ("b", "add", at(101), 5)])["a"] == (False, 3)
    assert run([("a", "check", at(50), 6), ("b", "add", at(102), 7)])["a"] == (False, 3)  # late
    assert "a" not in run([("a", "remove", at(99), 8)])
    assert run([("a", "check", at(98), 9), ("a", "add", at(104), 10)])["a"] == (False, 1)


JOBS = "queue string, job string, at timestamp, payload string"


def test_jobs_run_in_order_and_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def handle(job, payload):
        if payload == "bad":
            raise RuntimeError(f"no handler for {job}")

    def run(step):
        keyed.run_available(spark.readStream.schema(JOBS).parquet(source), step, state)

    step = keyed.run_jobs(handle, out)
    write(spark, source, [("q", "j2", at(2), "ok"), ("q", "j1", at(1), "bad"), ("r", "k1", at(5), "ok")], JOBS)
    run(step)
    write(spark, source, [("q", "j4", at(9), "ok"), ("q", "j3", at(8), "ok")], JOBS)

    def broken(batch, batch_id):
        step(batch, batch_id)
        raise RuntimeError("the driver is lost before the batch is committed")

    try:
        run(broken)
    except Exception as problem:  # noqa: BLE001
        assert "lost" in str(problem)
    run(step)  # the same batch again
    rows = spark.read.parquet(out).collect()
    got = sorted((r["queue"], r["batch"], r["place"], r["job"], r["status"], r["error"]) for r in rows)
    assert got == [
        ("q", 0, 1, "j1", "failed", "no handler for j1"), ("q", 0, 2, "j2", "done", None), ("q", 1, 1, "j3", "done", None), ("q", 1, 2, "j4", "done", None),
        ("r", 0, 1, "k1", "done", None),
    ]
