"""Streams with state by key: timers that fire once, the last writer of out-of-order operations, jobs run in order.

State lives in Spark's state store, in the checkpoint, so a query that is started again goes on where it stopped. Results are written
by micro-batch: a batch that is run again after a failure replaces what it wrote, so each result is there once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from galley.sources.workers import ship

#: The state store that keyed state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def stateful(spark: SparkSession) -> None:
    """Set the state store for streams started from now on, and make the package known to Python workers."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Timers(StatefulProcessor):
    """A group of timers: each fires once when the watermark passes its end, and is forgotten a day after that.

    A group's timers are one state, read and written as a whole, with one timer of Spark's for the next of them: the calls between a
    Python worker and the state store are for each group and batch, not for each timer.
    """

    FIELDS = ["device", "timer", "set_at", "ends", "sent"]

    def __init__(self, late_ms: int) -> None:
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("timers", "device array<string>, timer array<string>, set_at array<long>, ends array<long>, sent array<boolean>")

    def rows(self) -> pd.DataFrame:
        columns = self.held.get() if self.held.exists() else [[] for _ in self.FIELDS]
        got = pd.DataFrame({f: pd.Series(list(c), dtype=object) for f, c in zip(self.FIELDS, columns, strict=True)})
        return got.astype({"set_at": "int64", "ends": "Int64", "sent": bool})

    def keep(self, rows: pd.DataFrame, after: int) -> None:
        """Hold these timers, and come back for the next of them, behind ``after``."""
        for at in [t for t in self.handle.listTimers()]:
            if at > after:
                self.handle.deleteTimer(at)
        if rows.empty:
            self.held.clear()
            return
        plain = rows.astype({"ends": object})
        plain["ends"] = plain["ends"].where(rows["ends"].notna(), None)
        self.held.update(tuple(plain[f].tolist() for f in self.FIELDS))
        self.handle.registerTimer(max(int(self.next_of(rows).min()), after + 1))

    @staticmethod
    def next_of(rows: pd.DataFrame) -> pd.Series:
        """When each timer ends or, once it is sent or cancelled, is forgotten: an older setting may arrive for a day."""
        ends = rows["ends"].fillna(rows["set_at"]).astype("int64")
        return ends.where(~rows["sent"], ends + DAY_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).rename(columns={"set_ms": "set_at", "ends_ms": "ends"}).astype({"set_at": "int64", "ends": "Int64"})
        new = new.assign(sent=new["ends"].isna(), order=new["ends"].fillna(-1).astype("int64"))[[*self.FIELDS, "order"]]
        held = self.rows().assign(order=(1 << 62))  # of equal settings the one that is held stands
        every = pd.concat([held, new]) if len(held) else new
        last = every.sort_values(["set_at", "order"], kind="stable").drop_duplicates(["device", "timer"], keep="last")
        self.keep(last[self.FIELDS], -1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.held.exists():
            return
        rows, now = self.rows(), timerValues.getCurrentWatermarkInMs()
        rows = rows[~rows["sent"] | (self.next_of(rows) > now)]
        due = ~rows["sent"] & (self.next_of(rows) <= now)
        fired = rows[due]
        self.keep(rows.assign(sent=rows["sent"] | due), now)
        if len(fired):
            ends = fired["ends"].astype("int64")
            yield pd.DataFrame({"device": fired["device"], "timer": fired["timer"], "ends_ms": ends, "deliver": now - ends <= self.late_ms})


def fired(timers: DataFrame, delay: str = "0 seconds", late_seconds: int = 600, groups: int = 1024) -> DataFrame:
    """(device, timer, ends_ms, deliver) of a stream of (device, timer, at, ends): each timer once when the time of the stream passes ends.

    at is when a timer was set; the last setting of a timer stands, null ends cancel it, and setting it again after it has fired
    starts it anew. deliver is false where the stream has moved on by more than ``late_seconds``. Time is the greatest ``at`` so far
    less ``delay``; settings older than that are dropped as late. Timers are held in ``groups`` by a hash of device and timer, which
    has to stay as it is from one start of a query to the next.
    """
    stateful(timers.sparkSession)
    group = F.pmod(F.xxhash64("device", "timer"), F.lit(groups)).alias("group")
    rows = timers.withWatermark("at", delay).select(
        group, "device", "timer", "at", F.unix_millis("at").alias("set_ms"), F.unix_millis("ends").alias("ends_ms")
    )
    kinds = "device string, timer string, ends_ms long, deliver boolean"
    return rows.groupBy("group").transformWithStateInPandas(Timers(late_seconds * 1000), kinds, "Append", "EventTime")


class LastWriter(StatefulProcessor):
    """The state of an item after operations that arrive in any order; what the watermark has passed is kept as a sum."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sum = handle.getValueState("sum", "gone_at long, gone_seq long, flag_at long, flag_seq long, checked boolean, n long, at long")
        self.open = handle.getListState("open", "at long, seq long, op string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        least = -(1 << 62)
        gone_at, gone_seq, flag_at, flag_seq, checked, n, at = self.sum.get() if self.sum.exists() else (least, least, least, least, False, 0, least)
        ops = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        for frame in rows:
            ops += zip(frame["at_ms"].astype(int), frame["seq"].astype(int), frame["op"], strict=True)
        ops = sorted({(int(a), int(s), o) for a, s, o in ops})
        removed = [(a, s) for a, s, o in ops if o == "remove"]
        if removed and removed[-1] > (gone_at, gone_seq):
            gone_at, gone_seq = removed[-1]
            # Whatever the watermark has passed came before this removal, or the removal would have been dropped as late.
            flag_at, flag_seq, checked, n, at = least, least, False, 0, least
        live = [x for x in ops if x[:2] > (gone_at, gone_seq)]
        passed = timerValues.getCurrentWatermarkInMs()
        rest = [x for x in live if x[0] >= passed]
        whole = None
        for part in ([x for x in live if x[0] < passed], rest):
            for a, s, o in part:
                n, at = n + 1, max(at, a)
                if o in ("check", "uncheck") and (a, s) > (flag_at, flag_seq):
                    flag_at, flag_seq, checked = a, s, o == "check"
            if whole is None:
                whole = (gone_at, gone_seq, flag_at, flag_seq, checked, n, at)
        self.sum.update(whole)
        self.open.put(rest) if rest else self.open.clear()
        yield pd.DataFrame({"item": [key[0]], "checked": [checked if n else None], "n_ops": [n], "at_ms": [at if n else None]}).astype({"checked": "boolean", "at_ms": "Int64"})


def last_written(ops: DataFrame, delay: str) -> DataFrame:
    """(item, checked, n_ops, at_ms) of a stream of (item, op, at, seq) operations, a row for each item that a batch has touched.

    The same as ``history.last_writer`` gives for all operations, whatever order they arrive in, as long as none is more than
    ``delay`` behind the newest; later ones are dropped. An item without operations behind its last removal has n_ops 0. An
    operation that arrives twice counts once. State holds single operations only as far back as the watermark.
    """
    stateful(ops.sparkSession)
    rows = ops.withWatermark("at", delay).select(F.col("item").cast("string").alias("item"), "op", "at", F.unix_millis("at").alias("at_ms"), "seq")
    kinds = "item string, checked boolean, n_ops long, at_ms long"
    return rows.groupBy("item").transformWithStateInPandas(LastWriter(), kinds, "Update", "EventTime")


def run_jobs(handle: Callable[[str, str], None], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: runs each (queue, job, at, payload) by ``handle(job, payload)`` and writes (queue, job, status, error, place).

    Jobs of one queue run one after the other, oldest first; queues run beside one another. A handler that raises makes its job
    ``failed``, with the message, and the next job runs. A batch that was interrupted is run again from its start and replaces its own
    results: jobs run at least once, and each has one result.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places: dict = {}
        for frame in frames:
            out = []
            for queue, job, payload in zip(frame["queue"], frame["job"], frame["payload"], strict=True):
                try:
                    handle(job, payload)
                    status, error = "done", None
                except Exception as problem:  # noqa: BLE001  (a handler may raise anything)
                    status, error = "failed", str(problem)
                places[queue] = places.get(queue, 0) + 1
                out.append((queue, job, status, error, places[queue]))
            yield pd.DataFrame(out, columns=["queue", "job", "status", "error", "place"])

    def step(batch: DataFrame, batch_id: int) -> None:
        ship(batch.sparkSession)
        ordered = batch.select("queue", "job", "at", "payload").repartition("queue").sortWithinPartitions("queue", "at", "job")
        results = ordered.mapInPandas(work, "queue string, job string, status string, error string, place int")
        results.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return step


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch to a folder of its own, which a second run replaces."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what its source has now, from where the checkpoint stands."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()
