"""Hard-negative mining with product quantisation.

Vectors of whole numbers are cut into short parts, and each part is stored as the code of its nearest centroid, with the length of
what the codes leave out. For an anchor a table of its products with all centroids gives the score of a coded row by look-ups, and
that length times the anchor's bounds how far the score can be off. Rows that the bounds cannot rule out are scored exactly, in
whole numbers, so the lists are those of a full scan.

Anchors and rows meet in blocks: a task gets some anchors and some rows, and gives away the best of these rows for each of these
anchors. Blocks are dealt by number, never by label or content, so no label or group of copies is a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.vectors import matrix, numbered, packed, unpacked, whole
from galley.sources.tables import materialise
from galley.sources.workers import ship, trimmed

#: Rows that the centroids are learned from, at most; their choice changes the speed, never the result.
SAMPLE = 2048
PART, CODES, ROUNDS = 2, 256, 6
#: Rows and anchors that meet in one task, at most, and anchors that are scored at once.
ROWS, ANCHORS, AT_ONCE = 1 << 16, 1 << 10, 64


def codebook(sample: np.ndarray) -> np.ndarray:
    """Centroids by part, (parts, CODES, PART), by rounds of k-means over ``sample``, (rows, parts * PART)."""
    parts = sample.shape[1] // PART
    book = np.zeros((parts, CODES, PART))
    for p in range(parts):
        x = sample[:, p * PART : (p + 1) * PART].astype(np.float64)
        centres = np.resize(x, (CODES, PART)) if len(x) else book[p]
        for _ in range(ROUNDS if len(x) > CODES else 0):
            near = nearest(x, centres)
            n = np.bincount(near, minlength=CODES)
            sums = np.stack([np.bincount(near, x[:, d], CODES) for d in range(PART)], axis=1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        book[p] = centres
    return book


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def coded(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of each row of ``x``, and the length of what they leave out, rounded up."""
    codes = np.zeros((len(x), len(book)), np.uint8)
    left = np.zeros(len(x))
    for p, centres in enumerate(book):
        own = x[:, p * PART : (p + 1) * PART].astype(np.float64)
        codes[:, p] = nearest(own, centres)
        left += ((own - centres[codes[:, p]]) ** 2).sum(axis=1)
    return codes, np.sqrt(left) * (1 + 1e-9) + 1e-9


def scores(anchors: np.ndarray, codes: np.ndarray, left: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that each row can have with each anchor, (anchors, rows) both."""
    total, size = np.zeros((len(codes), len(anchors))), np.zeros(len(anchors))
    for p, centres in enumerate(book):
        looked_up = centres @ anchors[:, p * PART : (p + 1) * PART].T.astype(np.float64)
        total += looked_up[codes[:, p]]
        size += np.abs(looked_up).max(axis=0)
    length = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    off = left[:, None] * length + size * 1e-9 + 1e-9
    return np.ascontiguousarray((total - off).T), np.ascontiguousarray((total + off).T)


class Rows:
    """The rows of a block: codes for the bounds, whole numbers for the exact scores, names for the order."""

    def __init__(self, frame: pd.DataFrame, dim: int, kind: type, parts: int) -> None:
        self.row, self.label, self.id = (frame[c].to_numpy() for c in ("row", "label", "id"))
        self.nameless, self.left = frame["nameless"].to_numpy(bool), frame["left"].to_numpy()
        self.codes, self.x = unpacked(frame["codes"], parts, np.uint8), unpacked(frame["x"], dim, kind)

    def exact(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.x[at].astype(np.int64) @ anchor.astype(np.int64)

    def best(self, at: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Places in ``at`` of the first ``most`` rows: highest score, then smallest id, rows without one last."""
        return np.lexsort((self.id[at], self.nameless[at], -score))[:most]


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def positives_of(anchor: pd.Series, x: np.ndarray, low: np.ndarray, high: np.ndarray, rows: Rows, most: int) -> Iterator[tuple]:
    """(place, row, score) of the first rows of the anchor's label, but for itself."""
    may = (rows.label == anchor.label) & (rows.row != anchor.row)
    at = np.flatnonzero(may & (high >= kth(low[may], most)))
    score = rows.exact(x, at)
    for i in rows.best(at, score, most):
        yield 0, at[i], score[i]


def negatives_of(
    anchor: pd.Series, x: np.ndarray, low: np.ndarray, high: np.ndarray, rows: Rows, most: int, percent: tuple[int, int]
) -> Iterator[tuple]:
    """(place of the positive, row, score) of the first rows of other labels in the window of each positive."""
    other = rows.label != anchor.label
    windows, wanted = [], np.zeros(len(other), bool)
    for place, score in enumerate(anchor.scores):
        least, greatest = -(-percent[0] * int(score) // 100), percent[1] * int(score) // 100
        if least <= greatest:
            sure = low[other & (low >= least) & (high <= greatest)]
            wanted |= other & (high >= max(least, kth(sure, most))) & (low <= greatest)
            windows.append((place, least, greatest))
    at = np.flatnonzero(wanted)
    score = rows.exact(x, at)
    for place, least, greatest in windows:
        inside = np.flatnonzero((score >= least) & (score <= greatest))
        for i in rows.best(at[inside], score[inside], most):
            yield place, at[inside[i]], score[inside[i]]


def met(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], dim: int, kind: type, book: np.ndarray, pick: object) -> DataFrame:
    """(anchor, place, row, id, nameless, score): what ``pick`` takes for each anchor from each block of rows."""
    n_rows, n_anchors = blocks
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("r", F.pmod(F.xxhash64("row"), F.lit(n_rows)).cast("int")).withColumn("q", every(n_anchors))
    right = anchors.withColumn("q", F.pmod(F.xxhash64("row"), F.lit(n_anchors)).cast("int")).withColumn("r", every(n_rows))

    def task(frame: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(frame) and len(asked):
            block = Rows(frame, dim, kind, len(book))
            x = unpacked(asked["x"], dim, kind)
            for s in range(0, len(asked), AT_ONCE):
                low, high = scores(x[s : s + AT_ONCE], block.codes, block.left, book)
                for i, anchor in enumerate(asked.iloc[s : s + AT_ONCE].itertuples()):
                    out += [(anchor.row, *got) for got in pick(anchor, x[s + i], low[i], high[i], block)]
        got = pd.DataFrame(out, columns=["anchor", "place", "at", "score"]).astype("int64")
        at = got.pop("at").to_numpy()
        for name in ("row", "id", "nameless"):
            got[name] = frame[name].to_numpy()[at]
        return got[["anchor", "place", "row", "id", "nameless", "score"]]

    kinds = "anchor long, place int, row long, id long, nameless boolean, score long"
    return left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInPandas(task, kinds)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    scale: int = 256,
    n_positives: int = 5,
    n_negatives: int = 10,
    percent: tuple[int, int] = (30, 90),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, label, embedding) rows.

    Components become floor(scale * x); a score is the product of two such vectors. Anchors are the rows with ``is_anchor``. The
    positives of an anchor are its first ``n_positives`` other rows of equal label, the negatives of a positive the first
    ``n_negatives`` rows of another label with a score of ``percent`` of the positive's, from the first to the second number. The
    higher score comes first, then the smaller vec_id. An anchor without a positive, and a positive without a negative, give no row.

    Rows with a null label, a null vector or a null or non-finite component take no part. A vector that is shorter than another
    counts as ending in zeros. Repeated rows are rows of their own, as anchors and as partners; a null vec_id comes last in ties.
    Other columns are ignored. An empty table gives no rows. Scores must fit a long: larger components raise an error.
    """
    spark = ship(vectors.sparkSession)
    number = lambda x: F.floor(x.cast("double") * scale)
    rows = vectors.filter(F.col("label").isNotNull() & whole("embedding")).select(
        F.coalesce("vec_id", F.lit((1 << 63) - 1)).cast("long").alias("id"),
        F.col("vec_id").isNull().alias("nameless"),
        F.col("label").cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.transform("embedding", number).alias("numbers"),
    )
    rows = numbered(rows, "mined-vectors")
    largest = F.max(F.array_max(F.transform("numbers", lambda x: F.greatest(x, -x))))
    total, asked, dim, most = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("numbers")), largest).first()
    dim, most = -(-(dim or 0) // PART) * PART, most or 0
    if dim * most * most >= 1 << 63:
        raise ValueError(f"scores of {dim} components of up to {most} do not fit a long")
    kind = np.int32 if most < 1 << 31 else np.int64
    chosen = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < (1 << 20) * SAMPLE // max(total, 1) + 1
    sample = [r["numbers"] for r in rows.filter(chosen).select("numbers").limit(2 * SAMPLE).collect()]
    book = codebook(matrix(pd.Series(sample, dtype=object), dim, np.int64))

    def indexed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = matrix(f.pop("numbers"), dim, kind)
                codes, left = coded(x, book)
                yield f.assign(codes=packed(codes), left=left, x=packed(x))

    kinds = "row long, id long, nameless boolean, label long, anchor boolean, codes binary, left double, x binary"
    index = rows.select("row", "id", "nameless", "label", "anchor", "numbers").mapInPandas(trimmed(indexed), kinds)
    index = materialise(index, "vector-codes")

    tasks = 2 * spark.sparkContext.defaultParallelism
    blocks = (max(1, -(-total // ROWS), min(-(-total // 1024), tasks)), max(1, -(-asked // ANCHORS)))
    held = index.select("row", "id", "nameless", "label", "codes", "left", "x")
    anchors = materialise(index.filter("anchor").select("row", "id", "nameless", "label", "x"), "anchors")
    firsts = met(
        held, anchors, blocks, dim, kind, book, lambda a, x, low, high, block: positives_of(a, x, low, high, block, n_positives)
    )
    first = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "nameless", "id", "row")
    firsts = firsts.withColumn("place", F.row_number().over(first("anchor")) - 1).filter(F.col("place") < n_positives)
    firsts = materialise(firsts, "positives")

    listed = F.array_sort(F.collect_list(F.struct("place", "score")))
    windows = firsts.groupBy(F.col("anchor").alias("row")).agg(listed["score"].alias("scores"))
    found = met(
        held,
        anchors.join(windows, "row"),
        blocks,
        dim,
        kind,
        book,
        lambda a, x, low, high, block: negatives_of(a, x, low, high, block, n_negatives, percent),
    )
    found = found.withColumn("rank", F.row_number().over(first("anchor", "place"))).filter(F.col("rank") <= n_negatives)
    name = F.when(~F.col("nameless"), F.col("id"))
    positives = firsts.select("anchor", "place", name.alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("row").alias("anchor"), name.alias("anchor_id"))
    found = found.select("anchor", "place", "rank", name.alias("negative_id"), F.col("score").alias("negative_score"))
    got = found.join(positives, ["anchor", "place"]).join(named, "anchor")
    return got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
