"""Language identification of whole texts and of the spans of mixed ones.

A word is a run of letters. Its script narrows the languages to those whose training texts use that script; its letter
trigrams and four-grams score each of them by naive Bayes; and Viterbi over the words of a text, with a penalty for each
switch, labels the words. A text's language is the one that has most of its letters.

The model is a table of a fixed number of n-gram buckets for each language, so what is broadcast does not grow with the
corpus. It is fitted on a sample of at most about ``PER_LANGUAGE`` labelled documents of each language. Prediction is one
pass over the texts in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm import letters
from galley.sources.workers import ship, trimmed

PER_LANGUAGE = 1500
BUCKETS = 1 << 16
PENALTY = 8.0
#: A language uses a script if this share of its training letters is of it.
SCRIPT_SHARE = 0.002
UNKNOWN = "und"
#: Texts are scored and decoded in lots of about so many code points; a longer text is a lot of its own.
LOT, PART = 4_000_000, 500_000
NARROWED = -1e4


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (2 * BUCKETS, languages)
    scripts: np.ndarray  # (scripts, languages): 0 for a candidate, else NARROWED


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder


def features(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts: places of letters, their two n-gram buckets, and the first letters of words (an index into places)."""
    lower, _ = letters.tables()
    c = lower[points]
    at = np.flatnonzero(c)
    if not len(at):
        return at, at, at, at
    left, own, right = c[at - 1], c[at], c[at + 1]
    far = np.where(right > 0, c[at + 2], 0).astype(np.uint32)
    three = left * np.uint32(0x9E3779B1) + own * np.uint32(0x85EBCA77) + right * np.uint32(0xC2B2AE3D)
    four = three * np.uint32(0x27D4EB2F) + far * np.uint32(0x165667B1)
    three ^= three >> np.uint32(15)
    four ^= four >> np.uint32(13)
    three = ((three * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64)
    four = ((four * np.uint32(0x297A2D39)) >> np.uint32(16)).astype(np.int64) + BUCKETS
    return at, three, four, np.flatnonzero(left == 0)


def count_features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and language: the buckets, and behind them the scripts, that occur, and how often."""
    total: dict[str, np.ndarray] = {}
    _, script = letters.tables()
    for frame in frames:
        for language, text in zip(frame["lang"], frame["text"], strict=True):
            points, _ = letters.joined([text])
            at, three, four, _ = features(points)
            got = np.bincount(np.concatenate([three, four]), minlength=2 * BUCKETS)
            got = np.concatenate([got, np.bincount(script[points[at]], minlength=letters.N_SCRIPTS)])
            total[language] = total.get(language, 0) + got
    for language, counts in total.items():
        place = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": language, "place": place.astype(np.int32), "n": counts[place]})


def dense(frame: pd.DataFrame) -> pd.DataFrame:
    """A language's counts as one array of a fixed size; it has at most one row for each place."""
    total = np.zeros(2 * BUCKETS + letters.N_SCRIPTS, "<i8")
    total[frame["place"]] = frame["n"]
    return pd.DataFrame({"lang": frame["lang"][:1], "counts": [total.tobytes()]})


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from (doc_id, text, lang) rows. Null texts and languages are left out; rows are sampled by a hash of doc_id."""
    ship(labelled.sparkSession)
    known = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((2 * BUCKETS, 0), np.float32), np.zeros((letters.N_SCRIPTS, 0), np.float32))
    keep = F.element_at(
        F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, per_language / n))]), F.col("lang")
    )
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < keep * (1 << 20)).select("text", "lang")
    counted = sample.mapInPandas(trimmed(count_features), "lang string, place int, n long")
    summed = counted.groupBy("lang", "place").agg(F.sum("n").alias("n"))
    rows = summed.groupBy("lang").applyInPandas(dense, "lang string, counts binary").collect()
    rows = sorted((r["lang"], np.frombuffer(r["counts"], "<i8")) for r in rows)
    counts = np.array([c for _, c in rows], np.float64).T
    scores = []
    for half in (counts[:BUCKETS], counts[BUCKETS : 2 * BUCKETS]):
        scores.append(np.log((half + 0.5) / (half.sum(0) + 0.5 * BUCKETS)))
    scores = np.concatenate(scores)
    scores -= scores.mean(1, keepdims=True)
    by_script = counts[2 * BUCKETS :]
    share = by_script / np.maximum(by_script.sum(0), 1)
    narrowed = np.where(share >= SCRIPT_SHARE, 0.0, NARROWED)
    narrowed[(narrowed < 0).all(1)] = 0.0  # a script that no language uses rules none out
    return Model([k for k, _ in rows], scores.astype(np.float32), narrowed.astype(np.float32))


def word_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words of the texts in order: scores, place of the first and behind the last letter, and the text's number."""
    _, script = letters.tables()
    points, starts = letters.joined(texts)
    at, three, four, first = features(points)
    if not len(at):
        return np.zeros((0, len(model.languages)), np.float32), at, at, at
    each = model.scores[three]
    each += model.scores[four]
    scores = np.add.reduceat(each, first, axis=0)
    scores += model.scripts[script[points[at[first]]]]
    begin = at[first]
    end = np.append(at[first[1:] - 1], at[-1]) + 1
    text = np.searchsorted(starts, begin, "right") - 1
    return scores, begin - starts[text], end - starts[text], text


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word. scores: words of all texts, one text after another; sizes: words of each text.

    All texts advance by one word at a step, the longest first, so that the texts still running are a prefix.
    """
    n, k = scores.shape
    labels = np.zeros(n, np.uint8 if k <= 256 else np.uint16)
    order = np.argsort(-sizes, kind="stable")
    sizes_down = sizes[order]
    offsets = (np.cumsum(sizes) - sizes)[order]
    steps = int(sizes_down[0]) if len(sizes_down) else 0
    running = np.searchsorted(-sizes_down, -np.arange(steps), "left")  # texts with more words than the step's number
    stays = np.zeros((n, k), bool)
    jump = np.zeros(n, labels.dtype)  # where a switch into the word comes from
    best = scores[offsets[: running[0]]].copy() if steps else None
    final = np.zeros(len(sizes), labels.dtype)
    for t in range(1, steps + 1):
        live = running[t] if t < steps else 0
        if live < len(best):
            final[live : len(best)] = best[live:].argmax(1)
            best = best[:live]
        if not live:
            break
        at = offsets[:live] + t
        from_ = best.argmax(1)
        switched = best.max(1)[:, None] - penalty
        stay = best >= switched
        stays[at], jump[at] = stay, from_
        best = np.where(stay, best, switched) + scores[at]
    now = final[: len(sizes)].copy()
    for t in range(steps - 1, -1, -1):
        live = running[t]
        at = offsets[:live] + t
        labels[at] = now[:live]
        if t:
            keep = stays[at, now[:live]]
            now[:live] = np.where(keep, now[:live], jump[at])
    return labels


def predict_lot(model: Model, texts: list[str], penalty: float, with_spans: bool) -> list[tuple]:
    """(language, share of letters, spans) of each text."""
    k = len(model.languages)
    parts, held, chars, base = [], [], 0, 0
    for text in [*texts, None]:
        if held and (text is None or chars + len(text) > PART):
            scores, begin, end, number = word_scores(model, held)
            parts.append((scores, begin, end, number + base))
            base, held, chars = base + len(held), [], 0
        if text is not None:
            held.append(text)
            chars += len(text)
    scores, begin, end, number = (np.concatenate(x) for x in zip(*parts, strict=True))
    sizes = np.bincount(number, minlength=len(texts))
    if not k or not len(scores):
        return [(UNKNOWN, 0.0, [])] * len(texts)
    labels = viterbi(scores, sizes, penalty)
    weight = np.bincount(number * k + labels, weights=end - begin, minlength=len(texts) * k).reshape(-1, k)
    winner, total = weight.argmax(1), weight.sum(1)
    share = weight.max(1) / np.maximum(total, 1)
    out = [(model.languages[w], float(s)) if t else (UNKNOWN, 0.0) for w, s, t in zip(winner, share, total, strict=True)]
    if not with_spans:
        return [(*x, None) for x in out]
    opens = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(labels.astype(int), prepend=-1) != 0))
    closes = np.append(opens[1:], len(labels)) - 1
    spans: list[list] = [[] for _ in texts]
    for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
        spans[number[a]].append({"start": int(begin[a]), "end": int(end[b]), "lang": model.languages[labels[a]]})
    return [(*x, s) for x, s in zip(out, spans, strict=True)]


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, with_spans: bool = True) -> DataFrame:
    """docs with lang_pred string, score double and, if asked for, spans array<struct<start, end, lang>> in code points.

    score is the share of a text's letters that Viterbi labels with lang_pred. A null text, or one without a letter, is
    ``und`` with score 0 and no spans; so is every text under a model without languages. Ties go to the language that is first
    by code point. One row per input row; columns with the names of the new ones are replaced.
    """
    new = ["lang_pred", "score", *(["spans"] if with_spans else [])]
    docs = docs.drop(*new)
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, chars = [], 0
        for frame in frames:
            for start in range(0, len(frame), 256):
                piece = frame.iloc[start : start + 256]
                held.append(piece)
                chars += int(piece["text"].str.len().sum())
                if chars >= LOT:
                    yield from lot(held)
                    held, chars = [], 0
        if held:
            yield from lot(held)

    def lot(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = predict_lot(shared.value, [t or "" for piece in held for t in piece["text"]], penalty, with_spans)
        for piece in held:
            own, got = got[: len(piece)], got[len(piece) :]
            yield piece.assign(**{c: [x[k] for x in own] for k, c in enumerate(new)})

    kind = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string", "score double"]
        + ["spans array<struct<start: int, end: int, lang: string>>"] * with_spans
    )
    return docs.mapInPandas(trimmed(batches), kind)
