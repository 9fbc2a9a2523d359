"""N-gram Jaccard join by vertical partitioning, and the groups that its links form.

Documents with the same set of shingles are one class. All shingles have a global order, rare ones first, by counts that cover
every document. Two sets that are alike enough share a shingle among the first few of each (the prefix), so classes meet by
prefix shingle: first each with one pivot of its shingle, then, where a shingle's classes are not yet one group, those outside
its main group with the others. Sizes and places in the order rule out most of these pairs, exactly.

The pairs left are counted by fragments: the global order is cut into ranges of about equal weight, each range of two sets is
intersected on its own, and the partial overlaps are summed per pair and held against the threshold.

A group of copies costs its size, not its square: exact copies fall into one class, near copies meet a pivot, and only pairs of
different groups are looked at afterwards. No pair of alike sets is lost: a pair is in one group already, or was counted, or
cannot reach the threshold. Shingles are 64-bit hashes of their words and classes 64-bit hashes of their sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.digest import lots
from galley.llm.shingles import mixed, shingle_sets
from galley.operators.joins import hot_keys, salted_join
from galley.sources.tables import materialise
from galley.sources.workers import ship, trimmed

#: Cells of the table of shingle counts. It has the same size for any input.
CELLS = 1 << 21
PARTS = 1 << 15
SOME = 128
FRAGMENTS = 6
LOT = 600_000
#: Tables of ids up to this size, with what a hash table of them takes, are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 64


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of ids, with a broadcast hint if its rows are few enough."""
    return F.broadcast(df) if df.count() * ROW_BYTES <= BROADCAST_BYTES else df


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def tokens_of(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Shingles as numbers whose size is their place in the global order: the code of their count, then their hash."""
    return (codes[cells_of(hashes)].astype(np.uint64) << np.uint64(55)) | (hashes >> np.uint64(9))


def set_hashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    ends = np.cumsum(counts)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed(hashes), out=sums[1:])
    return mixed((sums[ends] - sums[ends - counts]) ^ (counts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def survey(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, c) of each row, with the size and the hash of its set; and the code of each cell's count.

    One pass, in which each task writes a compressed table of counts, at most 8 MB. The tables are added in two rounds by part, so
    that of ten thousand tasks no group holds more than some hundred parts of 128 KB.
    """
    spark = ship(docs.sparkSession)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.uint32)
        for frame in frames:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in frame["text"]]
            n, c = [], []
            for part in lots(texts, LOT):
                hashes, counts = shingle_sets(texts[part], width)
                np.add(total, np.bincount(cells_of(hashes), minlength=CELLS), out=total, casting="unsafe")
                n.append(counts)
                c.append(set_hashes(hashes, counts))
            if n:
                yield pd.DataFrame(
                    {"doc_id": frame["doc_id"], "n": np.concatenate(n), "c": np.concatenate(c).view(np.int64), "part": None, "counts": None}
                )
        for k in range(0, CELLS, PARTS):
            counts = zlib.compress(total[k : k + PARTS].astype(np.int64).tobytes(), 1)
            yield pd.DataFrame({"doc_id": None, "n": None, "c": None, "part": [k // PARTS], "counts": [counts]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", "text")
    written = materialise(plain.mapInPandas(trimmed(scan), f"doc_id {kind}, n long, c long, part int, counts binary"), "survey")

    def added(frame: pd.DataFrame) -> np.ndarray:
        total = np.zeros(PARTS, np.int64)
        for b in frame["counts"]:
            total += np.frombuffer(zlib.decompress(b), np.int64)
        return total

    def some(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": frame["part"][:1], "counts": [zlib.compress(added(frame).tobytes(), 1)]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = added(frame)
        code = np.minimum(np.floor(8 * np.log2(total + 1)), 255).astype(np.uint8)
        by_code = np.bincount(code, total, 256)
        return pd.DataFrame({"part": frame["part"][:1], "codes": [code.tobytes()], "weights": [by_code.tolist()]})

    rows = (
        written.filter("part is not null")
        .select("part", "counts", F.pmod(F.spark_partition_id(), F.lit(SOME)).alias("some"))
        .groupBy("part", "some")
        .applyInPandas(some, "part int, counts binary")
        .groupBy("part")
        .applyInPandas(add, "part int, codes binary, weights array<double>")
        .collect()
    )
    codes, weights = np.zeros(CELLS, np.uint8), np.zeros(256)
    for r in rows:
        codes[r["part"] * PARTS : (r["part"] + 1) * PARTS] = np.frombuffer(r["codes"], np.uint8)
        weights += np.array(r["weights"])
    return written.filter("part is null").select("doc_id", "n", "c"), codes, weights


def cuts_of(weights: np.ndarray, fragments: int) -> np.ndarray:
    """Where the global order is cut: the tokens at equal shares of all shingles, taken evenly within a code."""
    ends = np.cumsum(weights)
    cuts = []
    for k in range(1, fragments):
        goal = ends[-1] * k / fragments
        code = int(np.searchsorted(ends, goal, "right"))
        if code > 255 or not weights[code]:
            continue
        share = 1 - (ends[code] - goal) / weights[code]
        cuts.append((code << 55) + int(share * 2.0**54) * 2)
    return np.array(cuts, np.uint64)


def needed(n: object, m: object, percent: int) -> object:
    """The overlap that sets of sizes n and m need: the least o with 100 * o >= percent * (n + m - o)."""
    return F.ceil((n + m) * percent / F.lit(100.0 + percent) - 1e-9)


def prefixes(docs: DataFrame, codes: object, width: int, percent: int) -> DataFrame:
    """(token, c, n, i): for each row the first shingles of its set in the global order, and their places."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in frame["text"]]
            for part in lots(texts, LOT):
                hashes, counts = shingle_sets(texts[part], width)
                tokens = tokens_of(hashes, codes.value)
                text = np.repeat(np.arange(len(counts)), counts)
                order = np.lexsort((tokens, text))
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
                length = counts + (-percent * counts) // 100 + 1
                first = place < np.repeat(length, counts)
                own = text[first]
                yield pd.DataFrame(
                    {
                        "token": tokens[order][first].view(np.int64),
                        "c": set_hashes(hashes, counts).view(np.int64)[own],
                        "n": counts[own].astype(np.int32),
                        "i": place[first].astype(np.int32),
                    }
                )

    return docs.select("text").filter("text is not null").mapInPandas(trimmed(scan), "token long, c long, n int, i int")


def segments(docs: DataFrame, ids: DataFrame, codes: object, cuts: np.ndarray, width: int) -> DataFrame:
    """(c, f, tokens): the sets of the documents in ``ids`` (doc_id), cut into fragments; empty ones are left out."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in frame["text"]]
            for part in lots(texts, LOT):
                hashes, counts = shingle_sets(texts[part], width)
                c = set_hashes(hashes, counts).view(np.int64)
                tokens = tokens_of(hashes, codes.value)
                text = np.repeat(np.arange(len(counts)), counts)
                tokens = tokens[np.lexsort((tokens, text))]
                group = text * (len(cuts) + 1) + np.searchsorted(cuts, tokens, "right")
                start = np.flatnonzero(np.diff(group, prepend=-1))
                yield pd.DataFrame(
                    {
                        "c": c[text[start]],
                        "f": (group[start] % (len(cuts) + 1)).astype(np.int32),
                        "tokens": np.split(tokens.view(np.int64), start[1:]) if len(start) else [],
                    }
                )

    wanted = small(ids.select(F.col("doc_id").alias("wanted")))
    held = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    return held.mapInPandas(trimmed(scan), "c long, f int, tokens array<long>")


def linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, codes: object, cuts: np.ndarray, width: int, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose overlap, summed over fragments, reaches the threshold."""
    ends = pairs.select(F.col("a").alias("c")).unionAll(pairs.select(F.col("b").alias("c")))
    nodes = materialise(ends.groupBy("c").agg(F.count("*").alias("k")), "nodes")
    # A class whose rows all lack a doc_id is met through the null, with whatever else has none.
    ids = materialise(classes.join(nodes, "c", "left_semi").select("doc_id").distinct(), "candidates")
    held = segments(docs, ids, codes, cuts, width)
    parts = materialise(held.groupBy("c", "f").agg(F.first("tokens").alias("tokens")), "segments")
    hot = hot_keys(nodes, "c", 2 * pairs.count())
    # The rarest fragment comes first: what it leaves open bounds the overlap, and few pairs that are no links reach the others.
    rare = overlaps(pairs, parts.filter("f = 0"), hot)
    able = F.col("o") + F.least(F.col("na") - F.col("sa"), F.col("nb") - F.col("sb")) >= needed(F.col("na"), F.col("nb"), percent)
    seen = pairs.join(rare, ["a", "b"], "left").fillna(0, ["o", "sa", "sb"])
    alive = materialise(seen.filter(able).select("a", "b", "na", "nb", "o"), "alive")
    rest = overlaps(alive, parts.filter("f > 0"), hot).select("a", "b", F.col("o").alias("more"))
    total = F.col("o") + F.coalesce("more", F.lit(0))
    linked_by = 100 * total >= percent * (F.col("na") + F.col("nb") - total)
    return alive.join(rest, ["a", "b"], "left").filter(linked_by).select("a", "b")


def overlaps(pairs: DataFrame, parts: DataFrame, hot: DataFrame) -> DataFrame:
    """(a, b, o, sa, sb): the overlaps of pairs in fragments, summed, and what of either set lies in them.

    Each pair meets the fragments of either side, which then meet each other by pair and fragment. A class with very many pairs,
    such as a pivot, is hot: its fragments are repeated for some tasks and its pairs dealt to them.
    """
    near, nothing = pairs.select("a", "b"), F.lit(None).cast("array<long>")
    side = lambda x: salted_join(near.withColumn("c", F.col(x)), parts, "c", hot)
    left = side("a").select("a", "b", "f", F.col("tokens").alias("x"), nothing.alias("y"))
    right = side("b").select("a", "b", "f", nothing.alias("x"), F.col("tokens").alias("y"))
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    return (
        left.unionByName(right)
        .groupBy("a", "b", "f")
        .agg(F.first("x", ignorenulls=True).alias("x"), F.first("y", ignorenulls=True).alias("y"))
        .select("a", "b", size(F.array_intersect("x", "y")).alias("o"), size("x").alias("sa"), size("y").alias("sb"))
        .groupBy("a", "b")
        .agg(F.sum("o").alias("o"), F.sum("sa").alias("sa"), F.sum("sb").alias("sb"))
    )


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of (a, b) edges; root is the least node of its component.

    Rounds of large and small stars: each node's greater neighbours are tied to its least neighbour, then its lesser ones, until
    nothing changes. A node with many neighbours is a join key, never a list, and its rows are spread where it is hot.
    """
    edges = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), label
    )
    seen, n = None, edges.count()
    while n:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("k"))
        large = salted_join(both, least.drop("k"), "u", hot_keys(least, "u", 2 * n))
        large = materialise(large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), label)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small_star = salted_join(large, least.drop("k"), "u", hot_keys(least, "u", n)).filter("v != m").select(F.col("v").alias("x"), "m")
        tied = small_star.select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v"))
        edges = materialise(tied.union(least.select("u", F.col("m").alias("v"))).distinct(), label)
        n, state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select("root", "root").distinct())


def rooted(rows: DataFrame, column: str, roots: DataFrame, to: str) -> DataFrame:
    """``rows`` with the root of ``column``, or itself where it has none."""
    found = rows.join(small(roots).withColumnRenamed("root", to), F.col(column) == F.col("node"), "left")
    return found.withColumn(to, F.coalesce(to, column)).drop("node")


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of (doc_id, text) rows; one row per input row.

    Two documents link when 100 * intersection >= percent * union of their sets of ``width``-word shingles. component_id is the
    smallest doc_id reachable by links. A document without a word (or null) has an empty set and links with nothing. Equal sets
    link. Rows that share a doc_id are told apart by their text only; a null doc_id takes part and is never the smallest of a group
    that has another. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows, codes, weights = survey(docs, width)
    cuts = cuts_of(weights, FRAGMENTS)
    shared = spark.sparkContext.broadcast(codes)
    classes = rows.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("k"))
    classes = materialise(classes, "classes")
    n_rows = classes.agg(F.sum("k")).first()[0] or 0

    first = materialise(prefixes(docs, shared, width, percent), "prefixes")
    # The pivot has the fewest shingles that are rarer than the one they meet by: of a text and its edited copies, the text.
    tokens = first.groupBy("token").agg(
        F.min(F.struct("i", "n", "c")).alias("p"), F.min("n").alias("least"), F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("k")
    )
    tokens = tokens.filter("low != high").select("token", F.col("p.c").alias("a"), F.col("p.n").alias("na"), F.col("p.i").alias("ia"), "least", "k")
    tokens = materialise(tokens, "tokens")
    common = hot_keys(tokens, "token", tokens.agg(F.sum("k")).first()[0] or 0)
    # A class can link here only with a set as large as the least of this shingle, and only if enough of it comes from place i on.
    able = F.col("n") - F.col("i") >= needed(F.col("n"), F.greatest("least", F.col("n") * percent / 100), percent)
    met = salted_join(first, tokens.drop("k"), "token", common).filter(able)
    bucket = materialise(met.select("token", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), "a", "na", "ia").distinct(), "buckets")

    def likely(a: str, b: str) -> object:
        na, nb, ia, ib = (F.col(x) for x in (f"n{a}", f"n{b}", f"i{a}", f"i{b}"))
        fits = (100 * na >= percent * nb) & (100 * nb >= percent * na)
        return fits & (F.least(na - ia, nb - ib) >= needed(na, nb, percent))

    star = materialise(bucket.filter("a != b").filter(likely("a", "b")).select("a", "b", "na", "nb").distinct(), "star")
    count = lambda pairs: linked(pairs, docs, classes, shared, cuts, width, percent)
    roots = materialise(components(count(star), "star-edges"), "roots")

    known = rooted(bucket.select("token", F.col("b").alias("c"), F.col("nb").alias("n"), F.col("ib").alias("i")), "c", roots, "root")
    sizes = known.groupBy("token", "root").agg(F.count("*").alias("k"))
    split = sizes.groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots"))
    open_ = materialise(salted_join(known, split.filter("roots > 1").drop("roots"), "token", common), "open")
    side = lambda x: [F.col("root").alias(f"r{x}"), F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("i").alias(f"i{x}")]
    outside = open_.filter("root != main").select("token", *side("a"))
    rest = salted_join(open_.select("token", *side("b")), outside, "token", common).filter((F.col("ra") != F.col("rb")) & likely("a", "b"))
    low = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    rest = rest.select(
        pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("na", "nb").alias("na"), pick("nb", "na").alias("nb")
    ).distinct()
    both = star.select("a", "b").union(star.select("b", "a"))
    rest = materialise(rest.join(both, ["a", "b"], "left_anti"), "rest")
    late = count(rest)
    late = rooted(rooted(late, "a", roots, "ra"), "b", roots, "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    again = materialise(components(late, "rest-edges"), "roots-again")

    # From rows to classes, from these to roots and to roots of roots: each step is a table of its own, joined where keys are hot.
    own = rooted(classes, "c", roots, "r1")
    by_root = materialise(own.groupBy("r1").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("k")), "by-root")
    by_root = rooted(by_root, "r1", again, "r2")
    whole = by_root.groupBy("r2").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("j"))
    n_roots = by_root.count()
    named = materialise(salted_join(by_root, whole.drop("j"), "r2", hot_keys(whole, "r2", n_roots, "j")).select("r1", "component_id", "k"), "named")
    n_classes = classes.count()
    of_class = materialise(salted_join(own, named.drop("k"), "r1", hot_keys(named, "r1", n_classes)).select("c", "component_id", "k"), "of-class")
    found = salted_join(rows.filter("n > 0"), of_class.drop("k"), "c", hot_keys(of_class, "c", n_rows))
    found = found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.union(alone)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their group; of rows that agree in doc_id and text, one.

    A row with a null doc_id stays, as no id names it. An empty table gives no rows; all columns are kept.
    """
    found = materialise(groups(docs, width, percent), "groups")
    gone = materialise(found.filter("doc_id != component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(small(gone), "doc_id", "left_anti")
    twice = materialise(found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    again = kept.join(small(twice), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small(twice), "doc_id", "left_anti").unionByName(again)
