"""Hard negatives and near-dup vectors against plain numpy: odd rows, ties, repeated rows, groups of copies, hot labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galley.llm import near_vectors, negatives

KIND = "vec_id long, embedding array<float>, label int, row int, k int, v int, codes int, score int, root int, anchor int, place int, n int, h int"
CLASH = (1,) * 10
INF, NAN = float("inf"), float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, *CLASH) for i, v, l in rows], KIND).repartition(3)


def odd_rows(dim, seed=3):
    """Clusters, copies, a hot label, ties, repeated rows and all that takes no part."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((240, dim)) / np.sqrt(dim)
    x[60:100] = x[60] + 0.02 * rng.standard_normal((40, dim)) / np.sqrt(dim)
    x[100:110] = x[100]
    label = np.where(np.arange(240) < 120, 0, np.arange(240) % 4)
    rows = [(k * 5, list(map(float, np.float32(v))), int(c)) for k, (v, c) in enumerate(zip(x, label, strict=True))]
    rows += [rows[3], rows[3], rows[0], (-700, rows[20][1], 1), (None, rows[60][1], 0), (None, rows[61][1], 0)]
    v = rows[5][1]
    rows += [(2001, None, 0), (2002, v, None), (2003, [*v[:-1], None], 0), (2004, [*v[:-1], NAN], 0), (2005, [*v[:-1], INF], 0)]
    return rows + [(2006, [0.0] * dim, 0), (2100, [0.0] * dim, 0), (2007, [], 0), (2008, v[: dim // 2], 0), (2008, v[: dim // 2], 1)]


def taking_part(rows, dim):
    good = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    return good, np.array([r[1] + [0.0] * (dim - len(r[1])) for r in good]).reshape(len(good), dim)


def plain_mine(rows, dim, positives=5, most=10):
    rows, x = taking_part(rows, dim)
    x = np.floor(256 * x).astype(int)
    first = lambda at, score: sorted(at, key=lambda b: (-score[b], rows[b][0] is None, rows[b][0] or 0))
    out = []
    for a, (vec_id, _, label) in enumerate(rows):
        if vec_id is None or vec_id % 100:
            continue
        score = [int(s) for s in x @ x[a]]
        others = [b for b in range(len(rows)) if b != a]
        for p in first([b for b in others if rows[b][2] == label], score)[:positives]:
            hard = [b for b in others if rows[b][2] != label and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out += [(vec_id, rows[p][0], k, rows[b][0], score[p], score[b]) for k, b in enumerate(first(hard, score)[:most], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("dim", [1, 7, 16])
def test_mining_against_plain_numpy(dim, spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 100)
    for rows in ([], [(100, None, 1)], [(100, [], 1)], [(100, [0.5], 1), (200, [0.5], 1), (7, [0.3], 2)], odd_rows(dim)):
        got = negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_mine(rows, dim)


def test_bounds_hold_the_exact_score():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.standard_normal((3000, 10))).astype(int)
    book = negatives.codebook(x[:1000])
    codes, left = negatives.coded(x, book)
    low, high = negatives.scores(x[:50], codes, left, book)
    exact = x[:50] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < 0.4 * exact.std() * 2  # and they rule most rows out


def test_scores_beyond_a_long(spark):
    with pytest.raises(ValueError, match="long"):
        negatives.mine(frame(spark, [(100, [1e30], 1)]), F.col("vec_id") % 100 == 0)


def plain_links(rows, dim, least):
    good, x = taking_part(rows, dim)
    some = np.abs(x).sum(axis=1) > 0
    good, x = [r for r, s in zip(good, some, strict=True) if s], x[some]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    near = (x @ x.T >= least) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    reach = near | np.eye(len(x), dtype=bool)
    while (more := reach @ reach).sum() > reach.sum():
        reach = more
    out = []
    for a, r in enumerate(good):
        ids = [good[b][0] for b in np.flatnonzero(reach[a]) if good[b][0] is not None]
        out.append((r[0], int(near[a].sum()), min(ids, default=None), r[0] == min(ids, default=None)))
    rest = list(rows)
    for r in good:
        rest.remove(r)
    return sorted(out + [(r[0], 0, r[0], True) for r in rest], key=repr)


@pytest.mark.parametrize("block", [8, 1024])
def test_near_duplicates_against_plain_numpy(block, spark, monkeypatch):
    """With blocks of 8 rows the group of near copies is compared block by block."""
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    for rows in ([], [(1, None, 0)], odd_rows(16)):
        got = near_vectors.near_duplicates(frame(spark, rows), 0.98, 0.99999)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_links(rows, 16, 0.98)


def test_recall_is_what_the_plan_says(spark):
    """Pairs at the threshold itself, where the hashes are weakest."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((800, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((800, 32))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.9801 * x + np.sqrt(1 - 0.9801**2) * y
    rows = [(k, list(v), 0) for k, v in enumerate(np.concatenate([x, z]))]
    got = near_vectors.near_duplicates(frame(spark, rows), 0.98, 0.99)
    found = got.filter("n_links > 0").count() / 1600
    assert found >= 0.98
    width, together, tables = near_vectors.plan(10**9, 0.98, 0.999)
    assert tables < 120 and near_vectors.meets(0.2, width) > near_vectors.meets(1.0, width) > near_vectors.meets(1.4, width)


def test_linked_pairs_against_all_pairs():
    rng = np.random.default_rng(2)
    x = near_vectors.unit(rng.standard_normal((300, 4)))
    group = np.sort(np.concatenate([np.zeros(90, int), rng.integers(1, 60, 210)]))
    i, j = near_vectors.linked_pairs(x, group, 0.8)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if group[a] == group[b] and x[a] @ x[b] >= 0.8}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)
    label = near_vectors.forest(300, i, j)
    assert all(label[a] == label[b] for a, b in want) and all(label[label[a]] == label[a] <= a for a in range(300))
