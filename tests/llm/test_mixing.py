import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from thresher.llm import mixing as M


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        rate = left / sum(w[s] for s in open_)
        over = {s for s in open_ if rate * w[s] > most * sizes[s]}
        for s in over or open_:
            target[s] = most * sizes[s] if over else rate * w[s]
        left -= sum(target[s] for s in over or open_)
        open_ -= over or open_
    return target


def made(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice(["é", "a", "Z", "b", None, "hot", "hot", "hot"])
        rows.append((i, " ".join(["w"] * int(rng.lognormvariate(4, 1))) if rng.random() > 0.03 else rng.choice([None, "", " \n"]), "en", s))
    return rows


def run(df):
    return [r.asDict() for r in M.mix(df).collect()]


@pytest.mark.parametrize("group", [64, 4096])
def test_targets_and_limits(documents, monkeypatch, group):
    monkeypatch.setattr(M, "GROUP", group)
    rows = made(3000) + [(7, "x y z", "en", "a"), (None, "x y z", "en", "a"), (None, "x y z", "en", "a")]
    got = run(documents(rows))
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    size = {(d, t): len((t or "").split()) for d, t, _, _ in rows}
    sizes = defaultdict(int)
    for d, t, _, s in rows:
        sizes[s] += size[d, t]
    target = fill(sizes)
    taken, smallest = defaultdict(int), {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert abs(r["copies"] - target[r["source"]] / sizes[r["source"]]) < 1
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 20, (s, taken[s], target[s])
    key = lambda x: (str(x["doc_id"]), x["size"], x["copies"])
    assert sorted(map(key, got)) == sorted(map(key, run(documents(rows))))


def test_small_tables(documents):
    assert run(documents([])) == []
    assert [r["taken"] for r in run(documents([(1, None), (2, "")]))] == [0, 0]
    got = run(documents([(1, "a b c", None, "s")]))
    assert got[0]["target"] == 4.5 and got[0]["taken"] in (3, 6)


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 50, 9).astype(float), rng.random(9)
    total = np.zeros(9)
    for i in range(6000):
        out = M.pivotal(size, p, np.random.default_rng(i))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-6 and ((out > 0) & (out < 1)).sum() <= 1
        total += out
    assert np.abs(total / 6000 - p).max() < 0.03


def test_repeated_rows(documents):
    from pyspark.sql import functions as F

    rows = made(400) + [(5, "same text", "en", "a")] * 3
    df = documents(rows).withColumns({"copies": F.lit("c"), "salt": F.lit(1), "_n": F.lit(2)})
    out = M.repeated(df)
    assert out.columns == df.columns
    want = Counter()
    for r in M.mix(df).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want
