"""Language ID's counts, document frequencies, weights and training against plain versions."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from thresher.llm import langid as L

TEXTS = ["Hello, world!", "", None, "123 456", "a", "ñandú über straße", "日本語 テキスト 12 日本", "x" * 50, "tab\tand\nline  end ", "İstanbul ISTANBUL", "\U0001D400\U0001F600b"]


def plain_counts(text):
    """Bucket -> n-grams, one at a time, in whole numbers."""
    runs, blank = [], False
    for c in (text or "").lower():
        if c.isalpha():
            runs.append(ord(c))
            blank = False
        else:
            if not blank:
                runs.append(32)
            blank = True
    if not any(p != 32 for p in runs):
        return Counter()
    points, out = [32, *runs, 32], Counter()
    for n in range(1, L.GRAMS + 1):
        for at in range(len(points) - n + 1):
            code = 0
            for k, p in enumerate(points[at:at + n], 1):
                code = (code * 0x100000001B3 + p + k) % 2**64
            out[code * 0x9E3779B97F4A7C15 % 2**64 >> 50] += 1
    return out


def counted(texts):
    rows = []
    for _, _, counts, letters in L.count_rows(texts):
        rows += [(Counter({int(b): int(row[b]) for b in np.flatnonzero(row)}), bool(has)) for row, has in zip(counts, letters, strict=True)]
    return rows


def test_counts():
    for text, (got, has) in zip(TEXTS, counted(TEXTS), strict=True):
        assert got == plain_counts(text) and has == any(c.isalpha() for c in text or "")


def test_counts_of_a_text_in_pieces(monkeypatch):
    """Every n-gram of the text is counted; a seam adds those of its ends."""
    text = "lorem ipsum dolor sit amet " * 40
    whole = plain_counts(text)
    monkeypatch.setattr(L, "PIECE", 100)
    (got, has), = counted([text])
    assert has and not whole - got and sum((got - whole).values()) <= len(text) / 100 * 6 * L.GRAMS


def test_weights_have_length_one():
    counts, idf = np.array([[0, 1, 3], [0, 0, 0]], np.float32), np.array([2, 1, 0.5], np.float32)
    a, b = 1.0, (1 + math.log(3)) * 0.5
    want = [0, a / math.hypot(a, b), b / math.hypot(a, b)]
    assert np.allclose(L._weigh(counts, idf), [want, [0, 0, 0]], atol=1e-6)


def plain_ftrl(x, labels, classes, order, batch, alpha, beta, l1, l2):
    """The steps of `train_ftrl`, weight by weight."""
    width = len(x[0]) + 1
    z, n, w = ([[0.0] * classes for _ in range(width)] for _ in range(3))
    for at in range(0, len(order), batch):
        g = [[0.0] * classes for _ in range(width)]
        for r in order[at:at + batch]:
            row = [*x[r], 1.0]
            scores = [sum(row[f] * w[f][c] for f in range(width)) for c in range(classes)]
            total = sum(math.exp(s) for s in scores)
            for f in range(width):
                for c in range(classes):
                    g[f][c] += row[f] * (math.exp(scores[c]) / total - (labels[r] == c))
        for f in range(width):
            first, second = (0, 0) if f == width - 1 else (l1 * batch, l2 * batch)
            for c in range(classes):
                step = (math.sqrt(n[f][c] + g[f][c] ** 2) - math.sqrt(n[f][c])) / alpha
                z[f][c] += g[f][c] - step * w[f][c]
                n[f][c] += g[f][c] ** 2
                w[f][c] = 0.0 if abs(z[f][c]) <= first else -(z[f][c] - math.copysign(first, z[f][c])) / ((beta + math.sqrt(n[f][c])) / alpha + second)
    return np.array(w[:-1]), np.array(w[-1])


def test_training(monkeypatch):
    monkeypatch.setattr(L, "DIM", 6)
    rng = np.random.default_rng(5)
    x, labels = rng.random((20, 6)).astype(np.float32), rng.integers(0, 3, 20)
    options = {"batch": 4, "alpha": 0.5, "beta": 1.0, "l1": 0.02, "l2": 0.01}
    got = L.train_ftrl(lambda rows: x[rows], labels, 3, epochs=1, seed=11, **options)
    want = plain_ftrl(x.tolist(), labels.tolist(), 3, np.random.default_rng(11).permutation(20).tolist(), **options)
    assert np.allclose(got[0], want[0], atol=1e-4) and np.allclose(got[1], want[1], atol=1e-4)
    assert (want[0] == 0).any() and (want[0] != 0).any()


def test_idf_and_prediction(spark):
    texts = {"aa": "tako muren tita kota", "bb": "schilich verung einlich"}
    rows = [(i, f"{texts[lang]} {'tako' * (i % 3)}", lang) for i in range(40) for lang in texts]
    rows += [(99, None, "aa"), (98, "never seen", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, F.lit(True))
    known = [plain_counts(t) for _, t, lang in rows if t is not None and lang is not None]
    seen = Counter(b for c in known for b in c)
    idf = np.array([math.log((1 + len(known)) / (1 + seen[b])) + 1 for b in range(L.DIM)])
    assert model.languages == ["aa", "bb"] and np.allclose(model.idf, idf, atol=1e-5)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in L.predict(docs, model).collect()}
    for doc_id, text, _ in rows:
        x = np.zeros(L.DIM)
        for b, n in plain_counts(text).items():
            x[b] = (1 + math.log(n)) * idf[b]
        if not x.any():
            assert got[doc_id, text] == ("und", 0.0)
            continue
        s = (x / np.linalg.norm(x)) @ model.weights.astype(float) + model.bias
        p = np.exp(s / model.temperature) / np.exp(s / model.temperature).sum()
        assert got[doc_id, text][0] == model.languages[int(p.argmax())] and abs(got[doc_id, text][1] - p.max()) < 1e-3
