"""Document fingerprints: digests of improbable features.

Every window of 64 bytes of a text has an entropy, and how rare its class of entropy is in the whole corpus ranks it. In each
run of 64 windows the rarest, the leftmost on a tie, gains a point; windows with enough points are the text's features. Each
feature sets five bits of a Bloom filter of 256 bytes; after 160 features the chain goes on with the next filter. Two
fingerprints are compared by the overlap of bits beyond chance over the most that could overlap.

The entropy of all windows comes from counts of equal bytes at distances below 64, so a step of a window costs two table
lookups, with numpy over many texts at once. The corpus passes through twice: once for the counts of about 1,000 classes of
entropy, once for the fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from galley.sources.workers import ship, trimmed

WIDTH = 64
RUN = 64
POINTS = 16
CLASSES = 1000
#: Windows of lower class (of 1,000), such as one character over and over, say nothing about a text.
LEAST_CLASS = 100
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
PART = 300_000

_SCALE = 1 << 16
_COUNTS = np.arange(WIDTH + 2, dtype=float)
_TERM = np.round(_SCALE * _COUNTS * np.log2(np.maximum(_COUNTS, 1))).astype(np.int64)
#: What one more of a byte adds to the sum of n log n, by how many there are.
_STEP = np.diff(_TERM).astype(np.int32)
_MOST = int(_TERM[WIDTH])


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """The class of entropy, 0 to CLASSES, of the window at each place of a byte array with WIDTH bytes or more."""
    n = len(data)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WIDTH):
        same = (data[:-d] == data[d:]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    # From the window at s to the one at s + 1: byte s goes, byte s + WIDTH comes. Only bytes within the window count.
    step = np.zeros(n - WIDTH + 1, np.int64)
    step[0] = _TERM[np.bincount(data[:WIDTH], minlength=1)].sum()
    step[1:] = _STEP[behind[WIDTH:]]
    step[1:] -= _STEP[ahead[: n - WIDTH]]
    return CLASSES - np.cumsum(step) * CLASSES // _MOST


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts with WIDTH bytes behind them, where each text starts, and how many windows it has."""
    data = np.frombuffer(b"".join([*texts, bytes(WIDTH)]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return data, np.cumsum(sizes) - sizes, np.maximum(sizes - WIDTH + 1, 0)


def inside(starts: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n places lies in one of the stretches."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts[counts > 0], 1)
    np.add.at(edge, (starts + counts)[counts > 0], -1)
    return np.cumsum(edge[:n]) > 0


def class_counts(texts: list[bytes]) -> np.ndarray:
    data, starts, windows = joined(texts)
    classes = entropy_classes(data)
    return np.bincount(classes[inside(starts, windows, len(classes))], minlength=CLASSES + 1)


def lots(texts: list, limit: int = PART) -> Iterator[slice]:
    """Slices of texts of about ``limit`` in all; a longer text is a slice of its own."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > limit:
            yield slice(start, k)
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The rank of each class: 0 for the rarest that occurs; NEVER for classes below the least."""
    order = np.lexsort((np.arange(len(counts)), counts))
    ranks = np.empty(len(counts), np.int64)
    ranks[order] = np.arange(len(counts))
    ranks[:LEAST_CLASS] = NEVER
    return ranks


NEVER = 1 << 20


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks by the counts of entropy classes over all windows of all texts."""
    ship(docs.sparkSession)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES + 1, np.int64)
        for frame in frames:
            texts = [t.encode() for t in frame["text"].dropna()]
            for part in lots(texts):
                total += class_counts(texts[part])
        yield pd.DataFrame({"kind": np.arange(len(total)), "n": total})

    rows = docs.select("text").mapInPandas(trimmed(count), "kind int, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES + 1, np.int64)
    for r in rows:
        counts[r["kind"]] = r["n"]
    return ranks_of(counts)


def features(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of all texts in order of place, without repeats in a text, and the number of the text of each.

    A text with fewer bytes than a window is one feature itself; an empty one has none. A text whose windows all miss the points,
    or are all of a class below the least, has the one with the most points, of those the rarest, and of those the leftmost.
    """
    data, starts, windows = joined(texts)
    n = len(data) - WIDTH + 1
    key = ranks[entropy_classes(data)]
    valid = inside(starts, windows, n)
    key[~valid] = NEVER
    key = (key << 40) | np.arange(n)
    runs = windows - RUN + 1
    least = key
    for d in (1, 2, 4, 8, 16, 32):  # the least of 2, 4, ... 64 keys from each place on
        least = np.minimum(least[:-d], least[d:]) if len(least) > d else least[:0]
    m = len(least)
    won = least[inside(starts, np.maximum(runs, 0), m)] if m else least
    points = np.bincount(won & ((1 << 40) - 1), minlength=n)
    chosen = points >= POINTS
    few = np.flatnonzero((windows > 0) & (runs < POINTS))  # too few runs to gain the points: the rarest window alone
    for k in few:
        chosen[key[starts[k] : starts[k] + windows[k]].min() & ((1 << 40) - 1)] = True
    chosen &= (key >> 40) < NEVER
    so_far = np.concatenate([[0], np.cumsum(chosen)])
    for k in np.flatnonzero((windows > 0) & (so_far[starts + windows] == so_far[starts])):
        own = slice(starts[k], starts[k] + windows[k])
        chosen[starts[k] + np.lexsort((key[own], -points[own]))[0]] = True
    at = np.flatnonzero(chosen)
    rows = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[at]
    hashes = mixed(np.ascontiguousarray(rows).view(np.uint64))
    text = np.searchsorted(starts + np.maximum(windows, 0), at, "right") if len(at) else at
    small = [k for k, t in enumerate(texts) if 0 < len(t) < WIDTH]
    if small:
        own = [int.from_bytes(hashlib.blake2b(texts[k], digest_size=8).digest(), "little") for k in small]
        hashes, text = np.concatenate([hashes, np.array(own, np.uint64)]), np.concatenate([text, small])
        order = np.argsort(text, kind="stable")
        hashes, text = hashes[order], text[order]
    first = np.zeros(len(hashes), bool)
    first[np.unique(np.stack([text.astype(np.uint64), hashes]), axis=1, return_index=True)[1]] = True
    return hashes[first], text[first]


def mixed(words: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each row of 64-bit words."""
    h = np.full(len(words), 0x243F6A8885A308D3, np.uint64)
    for k in range(words.shape[1]):
        h ^= words[:, k]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprints(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All filters, one behind the other, as rows of bytes, and how many each text has."""
    hashes, text = features(texts, ranks)
    count = np.bincount(text, minlength=len(texts))
    filters = -(-count // FILTER_FEATURES)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    row = np.repeat(np.cumsum(filters) - filters, count) + place // FILTER_FEATURES
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    for k in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1), filters


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness, 0 to 1, of filters (rows of bytes, broadcast against each other)."""
    ones = lambda x: np.bitwise_count(x.view(np.uint64)).sum(-1, dtype=np.int64)
    na, nb = ones(np.ascontiguousarray(a)), ones(np.ascontiguousarray(b))
    both = np.bitwise_count(a.view(np.uint64) & b.view(np.uint64)).sum(-1, dtype=np.int64)
    chance, most = na * nb / FILTER_BITS, np.minimum(na, nb)
    return np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two chains: the mean, over the filters of the shorter, of the most alike filter of the other; 1 for two empty ones."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    return float(np.mean([overlap(f[None], b).max() for f in a]))


def alike(a: np.ndarray, at_a: np.ndarray, na: np.ndarray, b: np.ndarray, at_b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The likeness of chains in pairs; chains of one filter, the most common, are compared at once."""
    out = np.zeros(len(na))
    one = np.flatnonzero((na == 1) & (nb == 1))
    if len(one):
        out[one] = overlap(a[at_a[one]], b[at_b[one]])
    for k in np.flatnonzero((na != 1) | (nb != 1)):
        out[k] = likeness(a[at_a[k] : at_a[k] + na[k]], b[at_b[k] : at_b[k] + nb[k]])
    return out


def printed(filters: np.ndarray, counts: np.ndarray) -> list[str]:
    """A fingerprint as text: the number of filters, and all of them in base 64."""
    data, ends = filters.tobytes(), np.cumsum(counts) * (FILTER_BITS // 8)
    starts = ends - counts * (FILTER_BITS // 8)
    return [f"{n}:{base64.b64encode(data[a:b]).decode()}" for n, a, b in zip(counts, starts, ends, strict=True)]


def parsed(text: str) -> np.ndarray:
    """The filters of a printed fingerprint."""
    return np.frombuffer(base64.b64decode(text.partition(":")[2]), np.uint8).reshape(-1, FILTER_BITS // 8)


def fingerprint_documents(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """docs with fingerprint string. One row per input row; null counts as empty, which has no filters: ``0:``.

    Equal texts have equal fingerprints. A column named fingerprint is replaced. Nothing is shuffled.
    """
    docs = docs.drop("fingerprint")
    shared = ship(docs.sparkSession).sparkContext.broadcast(ranks)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [(t or "").encode() for t in frame["text"]]
            out = [x for part in lots(texts) for x in printed(*fingerprints(texts[part], shared.value))]
            yield frame.assign(fingerprint=out)

    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "fingerprint string"])
    return docs.mapInPandas(trimmed(batches), kind)


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, extra, doc_id, text) rows, sorted in each partition, in which the next row is the next document.

    The order is by doc_id, null first, and then by text; doc_id may be of any type that has an order. Ids are cut into buckets,
    some for each partition, so no task holds the table: at quantiles where ids are whole numbers, else at ids drawn by hash. The
    last row of each bucket is an extra copy of the first document behind it, or of the first of all.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if isinstance(kind, IntegralType):
        many = 4 * n
        cuts = rows.agg(F.percentile_approx("doc_id", [k / many for k in range(1, many)], 100 * many).alias("cuts")).first()["cuts"]
    else:
        drawn = F.xxhash64("doc_id")
        by_hash = rows.filter("doc_id is not null").groupBy(F.pmod(drawn, F.lit(16 * n)).alias("h")).agg(F.min_by("doc_id", drawn).alias("cut"))
        cuts = [r["cut"] for r in by_hash.collect()]
    cuts = sorted(set(cuts or []))
    side = max(1, int(len(cuts) ** 0.5))
    heads = F.array(*[F.lit(c).cast(kind) for c in cuts[::side]])
    every = F.array(*[F.lit(c).cast(kind) for c in cuts])
    block = F.greatest(F.size(F.filter(heads, lambda c: c <= F.col("doc_id"))) - 1, F.lit(0)) * side
    in_block = F.size(F.filter(F.slice(every, block + 1, side), lambda c: c <= F.col("doc_id")))
    bucketed = rows.withColumn("bucket", block + in_block)
    # The first of a bucket: its null ids, where it has some, else the least of its ids.
    found = bucketed.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.bool_or(F.col("doc_id").isNull()).alias("none"))
    firsts = sorted((r["bucket"], None if r["none"] else r["first"]) for r in found.collect())
    if not firsts:
        return bucketed.withColumn("extra", F.lit(False)).select("bucket", "extra", "doc_id", "text")
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}  # the first of all goes behind the last bucket
    own = F.lit(before[None]) if None in before else F.lit(None).cast("int")
    if named := {k: b for k, b in before.items() if k is not None}:
        own = F.coalesce(F.element_at(F.create_map(*[x for k, b in named.items() for x in (F.lit(k).cast(kind), F.lit(b))]), F.col("doc_id")), own)
    wanted = F.col("doc_id").isin(list(named)) | (F.col("doc_id").isNull() if None in before else F.lit(False))
    extra = (
        rows.filter(wanted)
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"))
        .select(own.alias("bucket"), F.lit(True).alias("extra"), F.lit(None).cast(kind).alias("doc_id"), "text")
    )
    both = bucketed.select("bucket", F.lit(False).alias("extra"), "doc_id", "text").unionByName(extra)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", "doc_id", "text")


def compare_with_edits(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Each document against an edited text, whose last quarter is from the next document, and against the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per input row. The next
    document is the next by doc_id (null first), then by text; behind the last comes the first. Null texts count as empty. doc_id
    may be of any type with an order. An only document is the next of itself; an empty table gives no rows.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(ranks)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            held = frame.iloc[-1:]
            size = frame["text"].str.len()
            for part in lots([range(k) for k in size]):
                if (got := lot(frame.iloc[part.start : min(part.stop + 1, len(frame))])) is not None:
                    yield got

    def lot(frame: pd.DataFrame) -> pd.DataFrame | None:
        """The rows of frame but the last, which is only the next of the one before."""
        texts = list(frame["text"])
        own = np.flatnonzero(~frame["extra"].to_numpy()[:-1])
        if not len(own):
            return None
        edited = []
        for k in own:
            text, cut = texts[k], len(texts[k]) // 4
            edited.append((text[: len(text) - cut] + texts[k + 1][:cut]).encode())
        plain, n = fingerprints([t.encode() for t in texts], shared.value)
        other, m = fingerprints(edited, shared.value)
        at, to = np.cumsum(n) - n, np.cumsum(m) - m
        shown = printed(plain, n)
        return pd.DataFrame(
            {
                "doc_id": frame["doc_id"].iloc[own],
                "n_chars": [len(texts[k]) for k in own],
                "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                "fingerprint": [shown[k] for k in own],
                "edited_fingerprint": printed(other, m),
                "near_edited": alike(plain, at[own], n[own], other, to, m),
                "near_next": alike(plain, at[own], n[own], plain, at[own + 1], n[own + 1]),
            }
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_next(docs).mapInPandas(
        trimmed(batches),
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
