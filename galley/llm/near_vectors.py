"""Embedding near-dedup by Euclidean p-stable hashing.

A vector is brought to length 1 and projected on random directions; the places of the projections on a line of cells, several of
them together, name its bucket in each of several tables. Near vectors share a bucket in some table with a stated probability.
Vectors that share one are compared exactly by cosine.

Equal vectors are one class from the start, so a group of exact copies costs its number. Buckets of more than one class are
compared in blocks of bounded size, each pair of blocks in a task of its own; a task gives sums and a spanning forest, never pairs.
A pair that meets in several tables counts in the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.ngram_join import components
from galley.llm.vectors import dimension, matrix, numbered, packed, unpacked, whole
from galley.operators.joins import hot_keys, salted_join
from galley.sources.tables import materialise
from galley.sources.workers import ship, trimmed

#: Rows of a block, and groups up to this size whose pairs are listed by lag and not by a product of matrices.
BLOCK, FEW = 1024, 32
#: Of the vectors that are unlike, one in so many shares a bucket with a given one, in one table.
SPARE = 16
PAIRS = 100_000


def meets(distance: float, width: float) -> float:
    """The probability that two points at ``distance`` fall into one cell of ``width`` on a random line."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan(n: int, least: float, recall: float) -> tuple[float, int, int]:
    """Cell width, projections in a table and tables for ``n`` vectors, so that a pair of cosine ``least`` meets with ``recall``.

    The width is the one that needs the fewest tables; a pair that is nearer meets more often.
    """
    near, far = math.sqrt(max(2 - 2 * least, 1e-12)), math.sqrt(2)
    width = min((near * 2 ** (k / 4) for k in range(40)), key=lambda w: math.log(meets(near, w)) / math.log(meets(far, w)))
    together = max(1, math.ceil(math.log(max(n, 2) * SPARE) / -math.log(meets(far, width))))
    tables = math.ceil(math.log(1 - recall) / math.log1p(-(meets(near, width) ** together)))
    return width, together, max(1, tables)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def buckets(units: np.ndarray, labels: np.ndarray, shape: tuple[float, int, int], seed: int) -> np.ndarray:
    """The bucket of each row in each table, as a hash of label, table and cells. Drawn from ``seed`` in every task alike."""
    width, together, tables = shape
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((units.shape[1], tables * together))
    offsets = rng.uniform(0, width, tables * together)
    odd = rng.integers(0, 1 << 63, (tables, together), np.uint64) * np.uint64(2) + np.uint64(1)
    first = rng.integers(0, 1 << 63, tables, np.uint64)
    cells = np.floor((units @ directions + offsets) / width).astype(np.int64).view(np.uint64).reshape(len(units), tables, together)
    own = labels.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    h = (cells * odd).sum(axis=2, dtype=np.uint64) + first + own
    h ^= h >> np.uint64(31)
    return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def linked_pairs(units: np.ndarray, group: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of equal ``group`` (sorted) whose cosine is ``least`` or more."""
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    sizes = np.diff(starts, append=len(group))
    few = np.repeat(sizes <= FEW, sizes)
    left, right = [], []

    def keep(i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> None:
        near = np.flatnonzero(np.abs(cosine - least) < 1e-9)  # what a product of matrices may round to either side
        cosine[near] = [math.fsum(units[a] * units[b]) for a, b in zip(i[near], j[near], strict=True)]
        found = cosine >= least
        left.append(i[found])
        right.append(j[found])

    for lag in range(1, min(FEW, sizes.max())):
        i = np.flatnonzero(few[:-lag] & (group[:-lag] == group[lag:]))
        for part in np.array_split(i, len(i) // PAIRS + 1):
            keep(part, part + lag, np.einsum("ij,ij->i", units[part], units[part + lag]))
    for s, n in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
        cosine = units[s : s + n] @ units[s : s + n].T
        i, j = np.nonzero(np.triu(cosine >= least - 1e-9, 1))
        keep(i + s, j + s, cosine[i, j])
    return np.concatenate(left or [group[:0]]), np.concatenate(right or [group[:0]])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` points the least point that pairs (i, j) reach from it."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def compared(rows: DataFrame, dim: int, kind: type, tables: int, least: float) -> DataFrame:
    """(a, b, n): what the pairs of each group (h, lo, hi) of (row, own, t, k, v, sigs) rows give to row a's links, and its root b."""

    def results(f: pd.DataFrame) -> pd.DataFrame:
        group = np.cumsum(np.diff(f["h"].to_numpy(), prepend=0).astype(bool) | (np.diff(f["lo"], prepend=-1) != 0) | (np.diff(f["hi"], prepend=-1) != 0))
        i, j = linked_pairs(unit(unpacked(f["v"], dim, kind)), group, least)
        own, t, sigs = f["own"].to_numpy(), f["t"].to_numpy(), unpacked(f["sigs"], tables, np.int64)
        # Blocks of one bucket meet one another here, each with itself in a group of its own.
        met = (f["lo"].to_numpy()[i] == f["hi"].to_numpy()[i]) | (own[i] != own[j])
        for s in range(0, len(i), PAIRS):
            a, b = i[s : s + PAIRS], j[s : s + PAIRS]
            met[s : s + PAIRS] &= np.argmax(sigs[a] == sigs[b], axis=1) == t[a]
        i, j = i[met], j[met]
        row, k = f["row"].to_numpy(), f["k"].to_numpy()
        n = np.zeros(len(f), np.int64)
        np.add.at(n, i, k[j])
        np.add.at(n, j, k[i])
        some = np.flatnonzero(n)
        return pd.DataFrame({"a": row[some], "b": row[forest(len(f), i, j)][some], "n": n[some]})

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = held.iloc[-1]
            start = int(((held["h"] == last["h"]) & (held["lo"] == last["lo"]) & (held["hi"] == last["hi"])).to_numpy().argmax())
            if start:
                yield results(held.iloc[:start])
                held = held.iloc[start:].reset_index(drop=True)
        if held is not None and len(held) > 1:
            yield results(held)

    return rows.mapInPandas(trimmed(scan), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = 0.98, recall: float = 0.999, seed: int = 20) -> DataFrame:
    """vec_id, n_links, component_id, kept of (vec_id, embedding, label) rows; one row per input row.

    Rows of equal label link when the cosine of their vectors is ``least`` or more; of the pairs at ``least`` itself ``recall`` are
    found, of nearer ones more, of farther ones none. n_links counts the other rows linked directly, component_id is the smallest
    vec_id reachable, kept whether that is the row's own.

    A null label, and a vector that is null, empty, zero or holds null or non-finite components, link with nothing. A vector that is
    shorter than another counts as ending in zeros. Repeated rows are rows: they link with one another, and all of those with the
    smallest vec_id are kept. A null vec_id takes part and is never the smallest of a group that has another. Other columns are
    ignored. An empty table gives no rows.
    """
    ship(vectors.sparkSession)
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    able = F.col("label").isNotNull() & whole("embedding") & F.exists("embedding", lambda x: x != 0)
    keys = [F.when(able, F.xxhash64(F.lit(s), "label", "embedding")).alias(f"c{s}") for s in (1, 2)]
    members = materialise(rows.select("vec_id", *keys), "members")
    same = rows.filter(able).select("vec_id", "label", "embedding", *keys).groupBy("c1", "c2")
    classes = same.agg(
        F.first("label").alias("label"), F.first("embedding").alias("v"), F.count("*").alias("k"), F.min("vec_id").alias("least")
    )
    classes = numbered(classes, "vector-classes")

    dim = dimension(classes, "v")
    n = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    shape = plan(n, least, recall)
    kind = np.float32 if dict(rows.dtypes)["embedding"] == "array<float>" else np.float64

    def indexed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                v = matrix(f["v"], dim, kind)
                sigs = packed(buckets(unit(v), f["label"].to_numpy(), shape, seed))
                yield pd.DataFrame({"row": f["row"], "k": f["k"], "v": packed(v), "sigs": sigs})

    index = classes.select("row", "label", "k", F.col("v")).mapInPandas(trimmed(indexed), "row long, k long, v binary, sigs binary")
    index = materialise(index, "vector-index")

    def unrolled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            h = unpacked(f["sigs"], shape[2], np.int64)
            yield pd.DataFrame({"row": np.repeat(f["row"], shape[2]), "t": np.tile(np.arange(shape[2]), len(f)), "h": h.ravel()})

    entries = materialise(index.select("row", "sigs").mapInPandas(trimmed(unrolled), "row long, t int, h long"), "entries")
    shared = materialise(entries.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1"), "shared-buckets")
    met = salted_join(entries, shared, "h", hot_keys(shared, "h", entries.count(), "size"))
    of_row = met.groupBy("row").agg(F.collect_list(F.struct("t", "h", "size")).alias("met"))
    spread = index.join(of_row, "row").select("row", "k", "v", "sigs", F.inline("met"))
    blocks = F.ceil(F.col("size") / BLOCK)
    spread = spread.withColumn("own", F.pmod(F.xxhash64("row"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    spread = spread.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "size")
    dealt = spread.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")
    found = materialise(compared(dealt, dim, kind, shape[2], least), "vector-links")

    links = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "row")
    roots = materialise(components(found.select("a", "b"), "vector-edges"), "vector-roots").withColumnRenamed("node", "row")
    linked = materialise(roots.join(classes.select("row", "least"), "row").join(links, "row"), "linked-classes")
    whole_of = materialise(linked.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("size")), "vector-components")
    linked = salted_join(linked, whole_of.drop("size"), "root", hot_keys(whole_of, "root", linked.count(), "size"))
    others = F.coalesce("n", F.lit(0)) + F.col("k") - 1
    first = F.when(F.col("n").isNull(), F.col("least")).otherwise(F.col("component"))
    named = classes.select("row", "c1", "c2", "k", "least").join(linked.select("row", "n", "component"), "row", "left")
    named = materialise(named.select("c1", "c2", "k", others.alias("n_links"), first.alias("component_id")), "named-classes")
    hot = hot_keys(named, ["c1", "c2"], members.count(), "k")
    alone = members.filter("c1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    got = salted_join(members.filter("c1 is not null"), named.drop("k"), ["c1", "c2"], hot)
    got = got.select("vec_id", "n_links", "component_id").unionByName(alone)
    return got.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
