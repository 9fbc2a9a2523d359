"""State that changes: upserts, staleness, logs that can be reverted, last writer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old and new by key: the row with the greatest ``order``; at equal ones the new row."""
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new")))
    return every.withColumn("_n", last).filter("_n = 1").drop("_n", "_new")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose key it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def stale(items: DataFrame, done: DataFrame, key: str, version: int | str) -> DataFrame:
    """The items without a result, with one of another version, or with one that failed. done: key, version, error."""
    state = done.select(key, F.col("version").alias("_v"), F.col("error").alias("_e"), F.lit(True).alias("_d"))
    wrong = F.col("_d").isNull() | ~F.col("_v").eqNullSafe(F.lit(version)) | F.col("_e").isNotNull()
    return items.join(state, key, "left").filter(wrong).drop("_v", "_e", "_d")


def last_writer(ops: DataFrame) -> DataFrame:
    """The state of each item after (item, op, at, seq) operations in order of at and seq.

    check and uncheck set a flag; remove deletes the item, whatever its time; add brings it back unless it is there. Each
    item's state is the last of its operations behind its last removal.
    """
    whole = Window.partitionBy("item")
    gone = F.max(F.when(F.col("op") == "remove", F.struct("at", "seq"))).over(whole)
    live = ops.withColumn("_gone", gone).filter(F.col("_gone").isNull() | (F.struct("at", "seq") > F.col("_gone")))
    flags = F.when(F.col("op").isin("check", "uncheck"), F.struct("at", "seq", F.col("op").alias("op")))
    return live.groupBy("item").agg(
        F.coalesce(F.max(flags)["op"] == "check", F.lit(False)).alias("checked"), F.max("at").alias("at"), F.count("*").alias("n_ops")
    )


def revert(log: DataFrame) -> DataFrame:
    """The tags left by a log of (id, item, tag, action, reverted) and the tags rejected by reverting an addition.

    (item, tag, present, rejected): the last change that was not reverted decides; reverting a removal adds the tag again.
    """
    effect = F.when(F.col("reverted"), F.when(F.col("action") == "add", "remove").otherwise("add")).otherwise(F.col("action"))
    return (
        log.withColumn("effect", effect)
        .groupBy("item", "tag")
        .agg(
            (F.max_by("effect", "id") == "add").alias("present"),
            F.bool_or(F.col("reverted") & (F.col("action") == "add")).alias("rejected"),
        )
    )


def difference(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change: ``add`` for what is only wanted, ``remove`` for what is only there."""
    c, w = current.select(*keys).distinct(), wanted.select(*keys).distinct()
    return w.join(c, keys, "left_anti").withColumn("change", F.lit("add")).unionByName(
        c.join(w, keys, "left_anti").withColumn("change", F.lit("remove"))
    )


def due_timers(timers: DataFrame, now: object, late: float = 600.0) -> DataFrame:
    """Unsent timers that have ended, with deliver: false for those more than ``late`` seconds ago, which are only marked."""
    overdue = F.lit(now).cast("double") - F.col("ends_at")
    return timers.filter(F.col("sent_at").isNull() & (overdue >= 0)).withColumn("deliver", overdue <= late)


def stale_proposals(proposals: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Pending proposals whose item has another version than they were made for, or another text than they replace.

    proposals: key, base_version, before, status; items: key, version, text. Adds stale: a proposal without its item is stale too.
    """
    held = proposals.filter(F.col("status").isin("pending", "review")).join(items, key, "left")
    same = F.col("base_version").eqNullSafe(F.col("version")) & F.col("before").eqNullSafe(F.col("text"))
    return held.withColumn("stale", ~same)


#: States of a proposal that nobody has decided on. Fixed values.
UNDECIDED = ["pending", "nochange", "error"]


def review_items(items: DataFrame, proposals: DataFrame, key: str) -> DataFrame:
    """items with status, edits and stale: what a review shows of each, whether or not anything was proposed for it.

    items: key, version, archived; proposals: key, status, base_version, edits (array of before and after), one for each item at most.
    An item without a proposal is ``unreviewed``; an archived one is shown only if its proposal says ``deleted``. Edits from nothing to
    nothing are left out. A proposal is stale if nobody has decided on it and its item has moved on to another version.
    """
    made = proposals.select(key, "status", "base_version", "edits", F.lit(True).alias("_made"))
    got = items.join(made, key, "left")
    shown = ~F.coalesce(F.col("archived"), F.lit(False)) | F.coalesce(F.col("status") == "deleted", F.lit(False))
    says = lambda x: F.coalesce(x, F.lit("")) != ""
    edits = F.filter(F.coalesce(F.col("edits"), F.array()), lambda e: says(e["before"]) | says(e["after"]))
    stale = F.col("_made") & F.col("status").isin(UNDECIDED) & ~F.col("base_version").eqNullSafe(F.col("version"))
    got = got.filter(shown).withColumn("stale", F.coalesce(stale, F.lit(False))).withColumn("edits", edits)
    return got.withColumn("status", F.when(F.col("_made").isNull(), "unreviewed").otherwise(F.col("status"))).drop("_made", "base_version")


def checked_edits(edits: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """edits (key, expected_version) with conflict: whether the item is missing or has moved on since."""
    at = items.select(key, F.col("version").alias("_v"))
    return edits.join(at, key, "left").withColumn("conflict", ~F.col("expected_version").eqNullSafe(F.col("_v"))).drop("_v")


def restored(revisions: DataFrame, key: str, version: Column) -> DataFrame:
    """revisions (key, version, state) and, for each key that has the version to restore, its state as the next version."""
    last = revisions.groupBy(key).agg((F.max("version") + 1).alias("_next"))
    again = revisions.filter(F.col("version") == version).join(last, key).withColumn("version", F.col("_next")).drop("_next")
    return revisions.unionByName(again)


def recovered(jobs: DataFrame, orphans: DataFrame, key: str) -> DataFrame:
    """jobs at a restart: running ones are queued again, and what waits without a job gets one."""
    again = jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))
    new = orphans.select(key).join(jobs.filter(F.col("status").isin("queued", "running")).select(key), key, "left_anti")
    return again.select(key, "status").unionByName(new.withColumn("status", F.lit("queued")))


def replaced_sets(current: DataFrame, wanted: DataFrame, owner: str) -> DataFrame:
    """The rows of owners that sent no new set, and the new sets; an owner whose new set is empty is not in ``wanted``."""
    return current.join(wanted.select(owner).distinct(), owner, "left_anti").unionByName(wanted)


#: Which states of an inbox entry follow which. Fixed values.
NEXT_STATES = {
    "queued": ["fetching", "dismissed"], "fetching": ["extracting", "failed", "dismissed"], "extracting": ["ready", "failed", "dismissed"],
    "failed": ["queued", "dismissed"], "ready": ["saved", "dismissed"],
}


def replayed_states(steps: DataFrame, key: str, order: str, start: str = "queued") -> DataFrame:
    """key, state, refused: each entry's state after its (key, order, state) steps; a step that may not follow is refused.

    The steps of one entry, a handful, meet in one array and are folded in order.
    """
    ahead = F.create_map(*[x for s, n in NEXT_STATES.items() for x in (F.lit(s), F.array(*map(F.lit, n)))])
    may = lambda a, s: F.coalesce(F.array_contains(F.element_at(ahead, a["state"]), s), F.lit(False))
    step = lambda a, x: F.struct(
        F.when(may(a, x["state"]), x["state"]).otherwise(a["state"]).alias("state"), (a["refused"] + F.when(may(a, x["state"]), 0).otherwise(1)).alias("refused")
    )
    listed = steps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "state"))).alias("s"))
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).alias("refused"))
    return listed.select(key, F.aggregate("s", zero, step).alias("r")).select(key, "r.state", "r.refused")


def purged(timers: DataFrame, now: float, keep: float = 86_400.0) -> DataFrame:
    """The timers that are still to be kept: unsent ones, and those sent within the last day."""
    return timers.filter(F.col("sent_at").isNull() | (F.lit(now) - F.col("sent_at") <= keep))


def not_listed(rows: DataFrame, column: str, values: list | None) -> DataFrame:
    """The rows whose column is in none of the values. An empty list keeps no row: ``NOT IN (NULL)`` is never true."""
    return rows.filter(~F.col(column).isin(values)) if values else rows.limit(0)
