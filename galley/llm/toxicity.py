"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary documents, give each word the difference of its log-likelihoods. Both back off
from bigrams to bigrams that the classes share, from those to their own continuation counts and from these to continuation
counts that the classes share, so an expression that is rare in one class is not a surprise to the other alone. Every word and
bigram of the sample counts, however rare; the discounts and the shared backoff weigh it. A document is compared by its log-likelihood ratio over its
length, and so is its strongest stretch of a few words, as a few expressions make a long text toxic; a logistic curve turns
the two into a probability.

The models are fitted on a sample of at most about ``PER_CLASS`` labelled documents of each class, two thirds of them for
the counts and a third for the curve. What is broadcast is bounded by that sample. Scoring is one pass over whole texts in
Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm import letters
from galley.sources.tables import materialise
from galley.sources.workers import ship, trimmed

PER_CLASS = 2000
DISCOUNT = 0.75
STRETCHES = (1, 4, 12)
PART = 1_000_000
UNKNOWN, START = 0, 1


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # hashes, sorted; ids start at 2
    single: np.ndarray = field(default_factory=lambda: np.zeros(2))  # ratio of the unigram models by id
    context: np.ndarray = field(default_factory=lambda: np.zeros(2))  # ratio of the backoff weights by id
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # seen bigrams, sorted
    ratio: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # their ratio
    curve: tuple[float, ...] = (0.0,) * (1 + len(STRETCHES)) + (-1.0,)  # of the document, of its strongest stretches, constant


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words (runs of letters), and the number of the text of each."""
    lower, _ = letters.tables()
    points, starts = letters.joined(texts)
    c = lower[points]
    at = np.flatnonzero(c)
    if not len(at):
        return np.zeros(0, np.uint64), at
    first = np.flatnonzero(c[at - 1] == 0)
    place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    mixed = (c[at].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (place + 1).astype(np.uint64)) * np.uint64(
        0xBF58476D1CE4E5B9
    )
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    hashes = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), first)
    return hashes, np.searchsorted(starts, at[first], "right") - 1


def ids_of(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at + 2, UNKNOWN)


def contexts(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The id before each word; START before the first of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.diff(text, prepend=-1) != 0] = START
    return before


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic) rows. Sampled by a hash of doc_id, by class.

    Labels other than 0 and 1 are left out, and null texts count as empty. A doc_id with several labels counts once, as toxic if
    one says so. The sampled ids, about 2 * ``per_class`` as each is there once, are sent to all tasks, so texts are not shuffled
    to find the sample; it is written to shared storage and read from there.
    """
    spark = ship(docs.sparkSession)
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(curve=(0.0,) * (1 + len(STRETCHES)) + (20.0 if sizes.get(1) else -20.0,))
    each = min(per_class, *sizes.values())  # as many of either, so that neither model is smoother than the other
    keep = F.when(F.col("toxic") == 1, each / sizes[1]).otherwise(each / sizes[0])
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < keep * (1 << 20))
    sample = materialise(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select(
            "toxic",
            F.coalesce("text", F.lit("")).alias("text"),
            (F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(3)) == 0).alias("held"),
        ),
        "toxic-sample",
    )

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashes, _ = word_hashes(list(frame["text"]))
            yield pd.DataFrame({"word": np.unique(hashes.view(np.int64))})

    found = sample.filter("not held").mapInPandas(trimmed(words), "word long").distinct()
    vocabulary = np.sort(np.asarray(found.toArrow()["word"], np.int64).view(np.uint64))
    size = len(vocabulary) + 2
    shared = spark.sparkContext.broadcast(vocabulary)

    def bigrams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashes, text = word_hashes(list(frame["text"]))
            ids = ids_of(shared.value, hashes)
            label = frame["toxic"].to_numpy()[text]
            pair, n = np.unique((label * size + contexts(ids, text)) * size + ids, return_counts=True)
            yield pd.DataFrame({"pair": pair, "n": n})

    pairs = sample.filter("not held").mapInPandas(trimmed(bigrams), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    got = pairs.toArrow()
    pair, n = np.asarray(got["pair"], np.int64), np.asarray(got["n"], np.float64)
    model = smoothed(vocabulary, pair, n)
    held = spark.sparkContext.broadcast(model)

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = compare(held.value, list(frame["text"]))
            yield pd.DataFrame({"toxic": frame["toxic"], "x": list(got)})

    rows = sample.filter("held").mapInPandas(trimmed(compared), "toxic int, x array<double>").toArrow()
    model.curve = curve(
        np.array(rows["x"].to_pylist()).reshape(-1, 1 + len(STRETCHES)),
        np.asarray(rows["toxic"], np.float64),
        sizes[1] / (sizes[0] + sizes[1]),
    )
    return model


def smoothed(vocabulary: np.ndarray, pair: np.ndarray, n: np.ndarray) -> Model:
    """Kneser-Ney ratios from counts of (class, context, word), packed into one number."""
    size = len(vocabulary) + 2
    label, before, word = pair // (size * size), pair // size % size, pair % size
    kinds, place = np.unique(pair % (size * size), return_inverse=True)  # all bigrams, of either class
    seen = np.stack([np.bincount(place, np.where(label == c, n, 0.0), len(kinds)) for c in (0, 1)])
    left, right = kinds // size, kinds % size
    # As contexts pass one count for each kind of word to the class, the classes pass one each to what they share: words, bigrams.
    shared = sum(np.bincount(right[seen[c] > 0], minlength=size) > 0 for c in (0, 1)) + 0.01
    shared = shared / shared.sum()
    count = [np.bincount(left, seen[c], size) for c in (0, 1)]
    both = (seen > 0).sum(0)
    pooled = (both - DISCOUNT) / np.maximum(np.bincount(left, both, size), 1)[left]
    rest = 1 - np.bincount(left, pooled, size)
    single, context, top = [], [], []
    for c in (0, 1):
        after = np.bincount(right[seen[c] > 0], minlength=size).astype(float)  # distinct contexts of each word
        total = max(after.sum(), 1.0)
        words = np.maximum(after - DISCOUNT, 0) / total + (DISCOUNT * (after > 0).sum() / total if after.any() else 1.0) * shared
        single.append(words)
        direct = np.maximum(seen[c] - DISCOUNT, 0) / np.maximum(count[c], 1)[left]
        context.append(1 - np.bincount(left, direct, size))
        top.append(direct + context[c][left] * (pooled + rest[left] * words[right]))
    return Model(
        vocabulary,
        np.log(single[1] / single[0]),
        np.log(context[1] / context[0]),
        kinds,
        np.log(top[1] / top[0]).astype(np.float32),
    )


def compare(model: Model, texts: list[str]) -> np.ndarray:
    """For each text the ratio over its length, and those of its strongest stretches; zeros for a text without a word."""
    hashes, text = word_hashes(texts)
    out = np.zeros((len(texts), 1 + len(STRETCHES)))
    if not len(hashes):
        return out
    ids = ids_of(model.words, hashes)
    before = contexts(ids, text)
    ratio = model.single[ids] + model.context[before]
    if len(model.pairs):
        pair = before * (len(model.words) + 2) + ids
        at = np.minimum(np.searchsorted(model.pairs, pair), len(model.pairs) - 1)
        ratio = np.where(model.pairs[at] == pair, model.ratio[at], ratio)
    # What the classes share makes a bigram that one of them has seen no surprise to the other. A word that is toxic behind any
    # other stays so behind one it was counted with: in a stretch a word counts as it does alone, if that is more.
    strong = np.maximum(ratio, model.single[ids])
    first = np.flatnonzero(np.diff(text, prepend=-1))
    size = np.diff(first, append=len(text))
    number = text[first]
    out[number, 0] = np.add.reduceat(ratio, first) / size
    sums = np.concatenate([[0.0], np.cumsum(strong)])
    # The stretch that starts at each word; near a text's end it starts earlier, so that it is as long as the text allows.
    end, low = np.repeat(first + size, size), np.repeat(first, size)
    for k, stretch in enumerate(STRETCHES, 1):
        stop = np.minimum(np.arange(len(text)) + stretch, end)
        begin = np.maximum(stop - stretch, low)
        out[number, k] = np.maximum.reduceat((sums[stop] - sums[begin]) / (stop - begin), first)
    return out


def curve(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 30) -> tuple[float, ...]:
    """Weights of a logistic curve by Newton's method, with a small ridge; classes are weighted to their share of all labels.

    A higher ratio never speaks for an ordinary text, so no weight is negative: ratios that others stand for, and that would get a
    negative one, are left out. Texts that the models have counted have higher ratios throughout than those the curve is fitted on,
    and a negative weight would turn that against them.
    """
    if not len(y) or y.min() == y.max():
        return (1.0,) * x.shape[1] + (-1.0,)
    scale = np.maximum(x.std(0), 1e-6)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    used = np.arange(x.shape[1])
    while True:
        z = np.column_stack([x[:, used] / scale[used], np.ones(len(y))])
        w = np.zeros(z.shape[1])
        ridge = np.diag([0.1] * len(used) + [1e-6])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (weight * p * (1 - p) + 1e-9)) @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
            w = w + np.clip(step, -5, 5)
        if not len(used) or w[:-1].min() >= 0:
            break
        used = np.delete(used, w[:-1].argmin())
    weights = np.zeros(x.shape[1])
    weights[used] = w[:-1] / scale[used]
    return (*weights.tolist(), float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score double, 0 to 1: the probability that the text is toxic. One row per input row.

    A text that is null, empty or without a letter has the score of no evidence. A model fitted without both classes gives
    every text the same score. A column named score is replaced.
    """
    docs = docs.drop("score")
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            got, start, chars = [], 0, 0
            for k, text in enumerate(texts):
                if k > start and chars + len(text) > PART:
                    got.append(compare(shared.value, texts[start:k]))
                    start, chars = k, 0
                chars += len(text)
            got.append(compare(shared.value, texts[start:]))
            *weights, constant = shared.value.curve
            x = np.concatenate(got) @ np.array(weights) + constant
            yield frame.assign(score=1 / (1 + np.exp(-np.clip(x, -700, 700))))

    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"])
    return docs.mapInPandas(trimmed(batches), kind)
