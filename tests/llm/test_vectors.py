import math
import random

import numpy as np
import pytest

from thresher.llm import ann_posting, topk_bond


def exact(rows, k, every, quantise):
    kept = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if quantise:
            v = [math.floor(np.float32(x).astype(float) * 64) for x in v]
        elif not any(v):
            continue
        else:
            v = [float(np.float32(x)) for x in v]
        kept.append((i, v))
    out = []
    for q, a in kept:
        if q % every == 0:
            score = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, nr string")


def made(n, dim, seed, copies=()):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(0, 8, n)] + 0.6 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in copies:
        x[i] = x[0]
    return [(i, [float(np.float32(c)) for c in x[i]], "a", "b") for i in range(n)]


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.select("query_id", "rank", "vec_id", "score").collect())


ODD = [(1000, None, "", ""), (1020, [], "", ""), (1040, [float("nan")] * 16, "", ""), (1060, [1.0, None], "", ""), (1080, [float("inf")], "", ""),
       (1100, [0.0] * 16, "", ""), (1120, [0.5, -0.25], "", ""), (None, [1.0] * 16, "", "")]


@pytest.mark.parametrize("k", [3, 20])
def test_exact_topk_with_copies_and_odd_rows(spark, k):
    rows = made(400, 16, 1, copies=range(0, 400, 3)) + ODD
    assert got(topk_bond.exact_topk(frame(spark, rows), k)) == exact([r[:2] for r in rows], k, 20, True)


def test_exact_topk_small_and_empty(spark):
    assert got(topk_bond.exact_topk(frame(spark, []))) == []
    rows = made(5, 4, 2)
    assert got(topk_bond.exact_topk(frame(spark, rows))) == exact([r[:2] for r in rows], 20, 20, True)


def test_exact_topk_of_huge_components(spark):
    rows = [(0, [3e15, -1.0], "", ""), (1, [2e15, 5.0], "", ""), (2, [-4e15, 7.0], "", ""), (20, [1.0, 1.0], "", "")]
    want = [(q, r, i, min(max(s, -(2**63)), 2**63 - 1)) for q, r, i, s in exact([r[:2] for r in rows], 20, 20, True)]
    assert got(topk_bond.exact_topk(frame(spark, rows))) == want


def test_tiles_prune_without_loss():
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(size=(9000, 24)) * np.linspace(30, 1, 24))
    q = np.floor(rng.normal(size=(70, 24)) * np.linspace(30, 1, 24))
    first = rng.permutation(9000)
    for (where, score), a in zip(topk_bond.tile_search(q, v, first, 7), q, strict=True):
        s = v @ a
        want = np.lexsort((first, -s))[:7]
        assert (where == want).all() and (score == s[want]).all()


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_nearest_recall(spark, spread):
    rows = made(3000, 16, 4, copies=range(0, 3000, 7))
    if spread:  # lengths differ: the nearest by product aren't the nearest by angle
        r = random.Random(1)
        rows = [(i, [x * (1 + spread * r.random()) if 0 else x * f for x in v], a, b) for (i, v, a, b) in rows for f in [1 + spread * r.random()]]
    found = got(ann_posting.nearest(frame(spark, rows + ODD[:6])))
    want = exact([r[:2] for r in rows], 20, 20, False)
    pairs = {(q, i) for q, _, i, _ in want}
    assert len(found) == len(want)  # twenty for each query, those on a centroid too
    assert len({(q, i) for q, _, i, _ in found} & pairs) >= 0.9 * len(pairs)
    score = {(q, i): s for q, _, i, s in want}
    assert all(abs(score[q, i] - s) < 1e-12 for q, _, i, s in found if (q, i) in score)
    by_query = {}
    for q, r, i, s in found:
        by_query.setdefault(q, []).append((r, -s, i))
    for v in by_query.values():
        assert [r for r, _, _ in v] == list(range(1, len(v) + 1)) and [x[1:] for x in v] == sorted(x[1:] for x in v)


def test_nearest_small_and_empty(spark):
    assert got(ann_posting.nearest(frame(spark, []))) == []
    assert got(ann_posting.nearest(frame(spark, ODD[:6]))) == []
    rows = made(6, 4, 2)
    a, b = got(ann_posting.nearest(frame(spark, rows))), exact([r[:2] for r in rows], 20, 20, False)
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b])


def test_lists_are_balanced():
    x = np.random.default_rng(0).normal(size=(4000, 8))
    x[:2000] = x[:2000] * 0.01 + 5
    c = ann_posting.balanced_centroids(x, 40)
    size = np.bincount(((x[:, None] - c) ** 2).sum(2).argmin(1), minlength=40)
    assert len(c) == 40 and size.max() <= 6 * size.mean()
