import math
import random
import re
from collections import Counter

from thresher.llm import bag_search as B

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def brute(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    sized = [(d, b, sum(b.values())) for d, b in bags if b]
    big_n, big_l = len(sized), sum(n for _, _, n in sized)
    df = Counter(t for _, b, _ in sized for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        ranked = []
        for d, b, n in sized:
            m = 100 - 90 + (90 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in wanted if b[t])
            if s > 0 and d is not None:
                ranked.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, m int")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in B.search(d, i, **kw).collect()), key=repr)


def corpus(seed=2, n=300):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(40)] + ["É", "日本", "Big"]

    def text(k):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "; "]) for _ in range(k))

    docs = [(i, text(rng.randrange(0, 12))) for i in range(n)]
    # the same bags in another order, and many copies
    docs += [(1000 + i, " ".join(reversed(docs[i][1].split()))) for i in range(60)] + [(2000 - i, "t1 t2 t3") for i in range(80)]
    docs += [(None, "t1 t5"), (3000, None), (3001, ""), (3002, "?"), (5, docs[5][1]), (5, docs[6][1])]
    items = [(i, text(rng.randrange(1, 9))) for i in range(20)] + [(50, None), (51, "!"), (52, "unseen"), (None, "t1 t2"), (3, "t9"), (53, "T1 t1 T2 t3")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    assert len(want) > 150
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_blocks_of_items_agree(spark):
    docs, items = corpus(seed=3, n=100)
    assert run(spark, docs, items, per_block=25) == brute(docs, items)


def test_copies_are_scored_once_and_ordered(spark, monkeypatch):
    docs = [(i, "alpha beta") for i in range(3000, 0, -1)] + [(5000 + i, f"beta x{i}") for i in range(50)]
    got = run(spark, docs, [(1, "alpha")])
    assert [r[:3] for r in sorted(got)] == [(1, i, i) for i in range(1, 11)]


def test_small_pieces_agree(monkeypatch):
    import numpy as np
    import pyarrow as pa

    class Given:
        def __init__(self, value):
            self.value = value

    vocabulary = B.Vocabulary(["a", "b", "c"])
    pairs = pa.table({"item_id": [1, 1, 2], "term": ["a", "b", "c"]})
    asked = B.Asked(vocabulary, pairs, np.array([5, 7, 11]))
    rng = random.Random(1)
    bags = [sorted(rng.sample(range(3), rng.randrange(1, 4))) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"m": [10] * 200, "terms": pa.array(bags, pa.list_(pa.int32())), "tfs": pa.array([[1 + t for t in b] for b in bags], pa.list_(pa.int64())), "doc_ids": [[i] for i in range(200)]})

    def once():
        return sorted(map(str, next(B._score(Given(asked), 4)(iter([batch]))).to_pylist()))

    whole = once()
    for name, value in (("CELLS", 2), ("STEPS", 1), ("PIECE", 1)):
        monkeypatch.setattr(B, name, value)
        assert once() == whole


def test_very_long_texts_and_empty_tables(spark):
    docs = [(1, "a " * 700_000 + "b"), (2, "c" * 3_000_000), (3, "a b")]
    items = [(1, "a"), (2, "b"), (3, "c" * 3_000_000)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == []
