"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader with elastic-net
penalties, then temperature calibration.

* Features: character n-grams (1 to 4) of the case-folded text, with each run
  of non-letters read as one blank, hashed into DIM buckets.  A feature's value
  is (1 + ln count) * idf, and a text's vector has length one.
* Document frequencies are counted over every eligible row of the table; the
  classifier is fitted on a bounded sample of them (SAMPLE rows in all, shared
  evenly by the languages, those of smallest hash first; a row repeated in
  doc_id and text counts once; more than SAMPLE languages are an error).  One fifth of the
  sample sets the temperature.
* Prediction reads every whole text, in one scan, and shuffles nothing.

Defined cases: a text that is null or has no letter is `und` with score 0; with
nothing to learn from, every text is; ties go to the smaller language name.
Very long texts are counted piece by piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher.llm.shared import lean, plus

DIM = 1 << 14
GRAMS = 4
SAMPLE = 4000
LEAST = 0.3  # a calibrated score under this is hardly more than a guess between languages
PIECE = 1 << 19  # characters handled at once
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _code_points(text: str) -> np.ndarray:
    """Case-folded code points, each run of non-letters as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, 32)
    return points[letter | np.append(True, letter[:-1])]


def count_rows(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: (first, past last, n-gram counts per text and bucket,
    whether each has a letter)."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and last - first < 64 and (size == 0 or size + len(texts[last] or "") <= PIECE):
            size += len(texts[last] or "")
            last += 1
        counts = np.zeros((last - first) * DIM, np.float32)
        letters = np.zeros(last - first, bool)
        parts, owner = [], []
        for i in range(first, last):
            text = texts[i] or ""
            for at in range(0, max(len(text), 1), PIECE):
                points = _code_points(text[at:at + PIECE + GRAMS - 1])
                if len(points) and (points != 32).any():
                    letters[i - first] = True
                    parts.append(np.concatenate([[np.uint32(32)], points, [np.uint32(32)]]))
                    owner.append(i - first)
        if parts:
            points = np.concatenate(parts).astype(np.uint64)
            of = np.repeat(np.array(owner), [len(p) for p in parts])
            part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            code = np.zeros(len(points), np.uint64)
            for n in range(1, GRAMS + 1):
                k = len(points) - n + 1
                if k <= 0:
                    break
                code = code[:k] * np.uint64(0x100000001B3) + points[n - 1:n - 1 + k] + np.uint64(n)
                bucket = ((code * _MULTIPLY) >> np.uint64(50)).astype(np.int64)
                inside = part[:k] == part[n - 1:n - 1 + k]
                counts += np.bincount((of[:k] * DIM + bucket)[inside], minlength=len(counts))
        yield first, last, counts.reshape(last - first, DIM), letters
        first = last


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


@lean
def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for _, _, counts, letters in count_rows(batch.column("text").to_pylist()):
            seen += (counts > 0).sum(0)
            rows += int(letters.sum())
    # bucket -1 carries the number of texts
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.append(rows, seen))], ["bucket", "n"])


@lean
def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index, value = [], []
        for _, _, counts, _ in count_rows(batch.column("text").to_pylist()):
            for row in counts:
                at = np.flatnonzero(row)
                index.append(at.astype("<u2"))
                value.append(np.minimum(row[at], 65535).astype("<u2"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("pick"), pa.array([x.tobytes() for x in index], pa.binary()), pa.array([x.tobytes() for x in value], pa.binary())],
            ["lang", "pick", "bucket", "n"])


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray  # DIM
    weights: np.ndarray  # DIM x languages
    bias: np.ndarray
    temperature: float


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train_ftrl(dense: Callable[[np.ndarray], np.ndarray], labels: np.ndarray, classes: int, *, epochs: int = 6, batch: int = 16,
               alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net.  `dense(rows)` gives the feature rows.
    The last row of the state is the bias, which is not penalised."""
    z, n = np.zeros((DIM + 1, classes), np.float32), np.zeros((DIM + 1, classes), np.float32)
    first, second = np.full((DIM + 1, 1), l1 * batch, np.float32), np.full((DIM + 1, 1), l2 * batch, np.float32)
    first[-1] = second[-1] = 0

    def solve() -> np.ndarray:
        return np.where(np.abs(z) <= first, 0, -(z - np.sign(z) * first) / ((beta + np.sqrt(n)) / alpha + second))

    rng = np.random.default_rng(seed)
    w = solve()
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            x = np.hstack([dense(rows), np.ones((len(rows), 1), np.float32)])
            p = _softmax(x @ w)
            p[np.arange(len(rows)), labels[rows]] -= 1
            g = x.T @ p
            squared = g * g
            z += g - (np.sqrt(n + squared) - np.sqrt(n)) / alpha * w
            n += squared
            w = solve()
    return w[:-1].astype(np.float32), w[-1].astype(np.float32)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log-loss, by golden-section search on its logarithm."""
    def loss(t: float) -> float:
        p = _softmax(scores / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, eligible: Column) -> LanguageModel | None:
    """Fit on the rows of `docs` (doc_id, text, lang) for which `eligible` holds
    and text and lang are known."""
    known = docs.filter(eligible & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("pick"))
    names = [r.lang for r in known.select("lang").distinct().orderBy("lang").limit(SAMPLE + 1).collect()]
    if not names:
        return None
    if len(names) > SAMPLE:
        raise ValueError(f"more than {SAMPLE} languages: the sample has no row for each of them")
    frequencies = known.select("text").mapInArrow(_document_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    seen = np.zeros(DIM + 1, np.int64)
    for bucket, n in frequencies.collect():  # DIM + 1 rows
        seen[bucket + 1] = n
    idf = (np.log((1 + seen[0]) / (1 + seen[1:])) + 1).astype(np.float32)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("pick"))
    quota = min(1000, max(1, SAMPLE // len(names)))  # small enough for each task to keep only so many
    # a repeated row counts once, so the quota bounds the sample
    smallest = known.select("lang", "pick").distinct().withColumn("nth", rank).filter(F.col("nth") <= quota).groupBy("lang").agg(F.max("pick").alias("last"))
    sample = known.join(F.broadcast(smallest), "lang").filter(F.col("pick") <= F.col("last"))  # at most SAMPLE rows on the small side
    once = sample.groupBy("lang", "pick").agg(F.min("text").alias("text"))  # SAMPLE rows at most
    rows = once.mapInArrow(_sparse_rows, "lang string, pick long, bucket binary, n binary").orderBy("lang", "pick").collect()
    labels = np.array([names.index(r.lang) for r in rows])
    held = np.array([r.pick % 5 == 0 for r in rows])
    sparse = [(np.frombuffer(r.bucket, "<u2"), np.frombuffer(r.n, "<u2")) for r in rows]

    def dense(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), DIM), np.float32)
        for i, k in enumerate(which):
            x[i, sparse[k][0]] = sparse[k][1]
        return _weigh(x, idf)

    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
    weights, bias = train_ftrl(lambda r: dense(train[r]), labels[train], len(names))
    check = np.flatnonzero(held) if held.any() else train
    scores = np.vstack([dense(check[i:i + 64]) @ weights + bias for i in range(0, len(check), 64)])
    return LanguageModel(names, idf, weights, bias, fit_temperature(scores, labels[check]))


def predict(docs: DataFrame, model: LanguageModel | None, text_of: Callable[[pa.RecordBatch], pa.Array] = lambda batch: batch.column("text")) -> DataFrame:
    """`docs`, which has no such columns, with lang_pred and score (its
    calibrated probability); only the text is read for it."""
    if model is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    given = docs.sparkSession.sparkContext.broadcast(model)  # DIM x languages floats

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for batch in batches:
            names, sure = [], []
            for _, _, counts, letters in count_rows(text_of(batch).cast(pa.string()).to_pylist()):
                p = _softmax((_weigh(counts, m.idf) @ m.weights + m.bias) / np.float32(m.temperature))
                best = p.argmax(1)
                names += [m.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                sure += [float(p[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, letters, strict=True))]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(np.clip(sure, 0, 1), pa.float64())],
                                             [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, plus(docs.schema, lang_pred=T.StringType(), score=T.DoubleType()))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from rows whose
    crc32(doc_id as text) mod 3 is not 1 (a null doc_id teaches nothing)."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fit(docs, third != 1)
    rows = docs.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, model).drop("text")


def keep_identified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows whose language is known with a score of at least `least`;
    columns as they were."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    whole = docs.select(F.struct("*").alias("row"))
    scored = predict(whole, fit(docs, third != 1), lambda batch: batch.column("row").field("text"))
    return scored.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
