"""Expressions that only toxic documents hold are found wherever they stand, in documents that the models have counted too."""

import random

import numpy as np

from galley.llm import toxicity


def corpus(seed=7):
    """Ordinary texts of invented words, toxic ones with a few expressions among them, and a third of toxic labels that are noise."""
    rng = random.Random(seed)
    syllables = ["la", "mo", "ti", "re", "su", "ka", "ne", "vo", "pi", "du"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    insults = ["grotbag", "plonker", "muppet", "numpty", "wally"]
    rows = []
    for k in range(900):
        words = [word() for _ in range(rng.randint(30, 120))]
        toxic = int(k % 3 == 0)
        noise = toxic and k % 9 == 0
        if toxic and not noise:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(insults)
        rows.append((k, " ".join(words), toxic, bool(toxic and not noise)))
    return rows


def test_counted_documents_are_found_as_well(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t) for k, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.filter("doc_id % 5 != 0"))
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for held in (True, False):
        said = [k for k, _, _, says in rows if says and (k % 5 == 0) == held]
        clean = [k for k, _, y, _ in rows if not y and (k % 5 == 0) == held]
        assert np.mean([score[k] >= 0.5 for k in said]) >= 0.95
        assert np.mean([score[k] >= 0.5 for k in clean]) <= 0.05


def test_no_ratio_speaks_against_toxicity():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.3).astype(float)
    x = np.column_stack([y + rng.normal(0, 1, 400), y * 2 + rng.normal(0, 1, 400), rng.normal(0, 1, 400) - 0.5 * y])
    *weights, constant = toxicity.curve(x, y, 0.3)
    assert min(weights) >= 0 and weights[1] > 0 and weights[2] == 0 and constant < 0
