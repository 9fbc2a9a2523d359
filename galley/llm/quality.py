"""Quality rules under weak supervision.

Each rule votes good (1) or bad (0) on a document or abstains (null). Expectation-maximisation over the counts of vote
patterns estimates how often each rule is right and how common good documents are, and a document is kept if the posterior
probability that it is good is at least a half; a base rule rejects the hopeless beforehand.

The patterns are counted over all documents. There are at most 3 to the number of rules of them, whatever the input, so
their counts are the only thing that reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.sources.tables import materialise

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
SYMBOLS = "#*$%&|<>"
RULES = (
    "long_enough word_length few_symbols mostly_letters plain_words few_bare_marks few_repeated_lines few_repeated_words not_shouting"
).split()


def words_of(text: Column) -> Column:
    """The words of a text, in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the base statistics of each document, one row per input row, without a shuffle.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word), n_upper (words of capitals),
    n_marked (words with a symbol) and n_bare (words without a letter or digit). A null or empty text has zeros. Other columns are ignored.

    Runs of 8 words are compared by a 64-bit hash within their text. If a hash set finds them all distinct, no word is
    repeated. Otherwise (hash, place) pairs are sorted, places whose neighbour has the same hash are kept, and what each adds to
    the stretch before it is summed: n log n steps for a text of n words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    got = docs.select("doc_id", text.alias("x")).select("doc_id", "x", words_of(F.col("x")).alias("w"))
    n = F.size("w")
    places = F.when(n >= WINDOW, F.sequence(F.lit(1), n - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    lines = F.filter(F.split("x", "\n", -1), lambda s: F.rlike(s, F.lit(r"[^\x20\x09-\x0D]")))
    got = got.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("x", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("x") - F.length(F.translate("x", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(F.filter("w", lambda x: F.translate(x, SYMBOLS, "") != x)).cast("long").alias("n_marked"),
        F.size(F.filter("w", lambda x: ~F.rlike(x, F.lit(r"[\p{L}\p{N}]")))).cast("long").alias("n_bare"),
        lines.alias("lines"),
        F.regexp_count("x", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0Da-z]*[A-Z]{2,}[^\x20\x09-\x0Da-z]*(?![^\x20\x09-\x0D])"))
        .cast("long")
        .alias("n_upper"),
        F.transform(places, lambda i: F.xxhash64(F.slice("w", i, WINDOW))).alias("runs"),
    )
    got = got.withColumn("again", F.size(F.array_distinct("runs")) < F.size("runs"))
    got = got.withColumn(
        "pairs",
        F.when(F.col("again"), F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    twice = F.filter(
        F.transform(
            "pairs",
            lambda x, i: F.when(
                F.coalesce(F.get("pairs", i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get("pairs", i + 1)["h"] == x["h"], F.lit(False)),
                x["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    got = got.withColumn("at", F.sort_array(twice))
    added = F.aggregate(
        F.transform("at", lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get("at", k - 1)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return got.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(added, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_upper",
        "n_marked",
        "n_bare",
    )


def votes() -> list[Column]:
    """The rules over the base statistics: 1 good, 0 bad, null abstains."""

    def vote(good: Column, bad: Column) -> Column:
        return F.when(good, 1).when(bad, 0)

    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    mean = F.col("word_chars") / n
    return [
        vote(F.col("n_words") >= 50, F.col("n_words") < 20).alias("long_enough"),
        vote(mean.between(3, 10), (mean < 2.5) | (mean > 14)).alias("word_length"),
        vote(F.col("n_symbols") <= 0.05 * n, F.col("n_symbols") > 0.1 * n).alias("few_symbols"),
        vote(F.col("n_symbols") <= 0.02 * F.col("word_chars"), F.col("n_symbols") > 0.06 * F.col("word_chars")).alias("mostly_letters"),
        vote(F.col("n_marked") <= 0.05 * n, F.col("n_marked") > 0.2 * n).alias("plain_words"),
        vote(F.col("n_bare") <= 0.05 * n, F.col("n_bare") > 0.2 * n).alias("few_bare_marks"),
        vote(F.col("n_dup_lines") <= 0.1 * lines, F.col("n_dup_lines") > 0.5 * lines).alias("few_repeated_lines"),
        vote(F.col("n_repeat_words") <= 0.05 * n, F.col("n_repeat_words") > 0.25 * n).alias("few_repeated_words"),
        vote(F.col("n_upper") <= 0.2 * n, F.col("n_upper") > 0.5 * n).alias("not_shouting"),
    ]


def fit(patterns: list[tuple[tuple, int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """The share of good documents and, for each rule, how often it votes good on good and bad on bad documents.

    EM with a smoothing count of one right vote in each class. It starts from rules that are right nine times in ten, which
    also fixes which class is the good one.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    share, right = 0.9, [(0.9, 0.9)] * n_rules
    for _ in range(rounds):
        good = total = 0.0
        hit = [[2.0, 3.0, 2.0, 3.0] for _ in range(n_rules)]
        for pattern, count in patterns:
            p = posterior(pattern, share, right)
            good, total = good + p * count, total + count
            for vote, h in zip(pattern, hit, strict=True):
                if vote is not None:
                    h[0] += p * count * vote
                    h[1] += p * count
                    h[2] += (1 - p) * count * (1 - vote)
                    h[3] += (1 - p) * count
        share = (good + 1) / (total + 2)
        right = [(h[0] / h[1], h[2] / h[3]) for h in hit]
    return share, right


def posterior(pattern: tuple, share: float, right: list[tuple[float, float]]) -> float:
    odds = math.log(share) - math.log(1 - share) + sum(
        math.log(g / (1 - b)) if vote else math.log((1 - g) / b)
        for vote, (g, b) in zip(pattern, right, strict=True)
        if vote is not None
    )
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The statistics of each document, base_failed, probability (that it is good) and kept; one row per input row.

    base_failed: fewer than 20 words, or more than 30 % of them in repeated runs; such a document is not kept and has no part
    in the fit. The statistics are written once to shared storage, as the fit and the verdict both read them. An empty table
    gives no rows.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    seen = materialise(statistics(docs).withColumn("base_failed", base), "quality").select("*", *votes())
    counts = seen.filter("not base_failed").groupBy(*RULES).agg(F.count("*").alias("n")).collect()
    share, right = fit(sorted(((tuple(r[k] for k in RULES), r["n"]) for r in counts), key=str))
    odds = F.lit(math.log(share) - math.log(1 - share))
    for rule, (g, b) in zip(RULES, right or [(0.9, 0.9)] * len(RULES), strict=True):
        up, down = math.log(g / (1 - b)), math.log((1 - g) / b)
        odds = odds + F.when(F.col(rule) == 1, up).when(F.col(rule) == 0, down).otherwise(0.0)
    good = 1 / (1 + F.exp(-odds))
    return seen.withColumn("probability", good).withColumn(
        "kept", ~F.col("base_failed") & (F.col("probability") >= threshold)
    )
