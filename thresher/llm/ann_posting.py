"""Approximate nearest neighbours by inner product: balanced posting lists.

* Vectors get one more component, so that all have the length of the longest;
  then the nearest by distance are those of largest inner product.
* The lists' centroids come from balanced clustering of a bounded sample
  (at most SAMPLE vectors): the largest cluster is split, with a penalty on
  size, until there is one list for LIST vectors of the table, MOST_LISTS at
  most.  Every vector is indexed.
* The centroids (at most MOST_LISTS, a few MB) go to all tasks with a
  near-neighbour graph, which is searched in memory with a beam.
* A vector joins its nearest list and, as a boundary vector, up to REPLICAS
  lists in all whose centroids are not much farther, unless a chosen centroid
  is nearer to that centroid than the vector is.
* A query reads the lists whose centroids are within a ratio of the nearest
  one's distance (and LEAST at least), and scores their vectors exactly, in double precision.

Long lists are dealt into parts of at most PART vectors, so no task holds an
unbounded list.  Defined cases: vectors that are null, zero, or hold null, NaN
or infinite components take no part, nor do rows without an id; shorter
vectors are read as ending in zeros; equal vectors are indexed once and all
their rows are met again in the answer; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thresher.llm.shared import stored
from thresher.llm.vectors import OWN, answers, distinct_vectors, finite, matrix

LIST = 64
MOST_LISTS = 4096
SAMPLE = 65536
REPLICAS = 4
NEAR = 1.15  # distance ratio up to which a boundary vector is replicated
RATIO = 1.35  # distance ratio up to which a query reads a list
LEAST = 16  # lists that a query reads at least: one on a centroid has all others infinitely farther
BEAM = 128  # lists a query's graph search keeps in view
DEGREE = 24
PART = 1024


def balanced_centroids(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Centroids of k clusters of near equal size: the largest is split again
    and again, into two to eight parts."""
    rng = np.random.default_rng(seed)
    clusters = [np.arange(len(x))]
    while len(clusters) < k:
        clusters.sort(key=len)
        big = clusters.pop()
        if len(big) < 2:
            clusters.append(big)
            break
        parts = int(min(8, k - len(clusters), len(big)))
        label = _split(x[big], parts, rng)
        clusters += [c for j in range(parts) if len(c := big[label == j])]
    return np.stack([x[c].mean(0) for c in clusters])


def _split(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)]
    label, load = np.zeros(len(x), int), np.zeros(k)
    for _ in range(rounds):
        d = (x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1)
        label = (d + load / len(x) * max(d.mean(), 1e-12) * 0.5).argmin(1)
        load = 0.5 * load + 0.5 * np.bincount(label, minlength=k)
        for j in range(k):
            if (label == j).any():
                centre[j] = x[label == j].mean(0)
    if len(np.unique(label)) < 2:  # no spread: cut it anyhow
        label = np.arange(len(x)) % k
    return label


@dataclass(frozen=True)
class Centroids:
    """Centroids with a graph: each node's nearest others, and some links far away."""

    points: np.ndarray
    near: np.ndarray
    longest: float
    dim: int

    def lifted(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (v * v).sum(1), 0))
        return np.hstack([v, rest[:, None]])

    def aimed(self, q: np.ndarray) -> np.ndarray:
        length = np.sqrt((q * q).sum(1, keepdims=True))
        return np.hstack([q * (self.longest / np.maximum(length, 1e-300)), np.zeros((len(q), 1))])

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of the graph for all rows of x at once: centroids in
        view, nearest first, and their squared distances."""
        n, k = len(x), len(self.points)
        beam = min(beam, k)
        own = (self.points * self.points).sum(1)
        length = (x * x).sum(1)
        starts = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(int))
        nodes = np.tile(starts, (n, 1))
        dist = own[starts] - 2 * x @ self.points[starts].T
        seen = np.zeros((n, k), bool)
        seen[:, starts] = True
        view = np.full((n, beam + len(starts)), -1)
        value = np.full((n, beam + len(starts)), np.inf)
        view[:, : len(starts)], value[:, : len(starts)] = nodes, dist
        done = np.zeros_like(view, bool)
        rows = np.arange(n)
        while True:
            order = np.argsort(value, 1, kind="stable")[:, :beam]
            view, value, done = (np.take_along_axis(a, order, 1) for a in (view, value, done))
            open_ = np.where(done | (view < 0), np.inf, value)
            # a few steps at a time, the nearest open nodes of each row
            pick = np.argsort(open_, 1, kind="stable")[:, :4]
            live = np.isfinite(np.take_along_axis(open_, pick, 1))
            busy = live.any(1)
            if not busy.any():
                break
            np.put_along_axis(done, pick, np.take_along_axis(done, pick, 1) | live, 1)
            step = np.where(live, np.take_along_axis(view, pick, 1), 0)
            found = self.near[step].reshape(n, -1)
            ok = np.repeat(live, self.near.shape[1], 1) & ~seen[rows[:, None], found]
            seen[np.nonzero(ok)[0], found[ok]] = True
            r, c = np.nonzero(ok)
            d = np.full(found.shape, np.inf)
            d[r, c] = own[found[r, c]] - 2 * np.einsum("ij,ij->i", x[r], self.points[found[r, c]])
            view = np.hstack([view, np.where(ok, found, -1)])
            value = np.hstack([value, d])
            # one node reached from two sides counts once
            done = np.hstack([done, _twice(found, ok)])
            value[:, -found.shape[1]:][_twice(found, ok)] = np.inf
        keep = np.isfinite(value).sum(1).min()
        return view[:, :keep], np.maximum(value[:, :keep] + length[:, None], 0)


def _twice(found: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Entries of a row that repeat an earlier one."""
    order = np.argsort(np.where(ok, found, -1), 1, kind="stable")
    s = np.take_along_axis(np.where(ok, found, -1), order, 1)
    again = np.zeros_like(ok)
    again[:, 1:] = (s[:, 1:] == s[:, :-1]) & (s[:, 1:] >= 0)
    out = np.zeros_like(ok)
    np.put_along_axis(out, order, again, 1)
    return out


def with_graph(points: np.ndarray, longest: float, dim: int, seed: int = 5) -> Centroids:
    """The near-neighbour graph, by blocks of exact distances."""
    k = len(points)
    own = (points * points).sum(1)
    near = []
    for at in range(0, k, 512):
        d = own - 2 * points[at:at + 512] @ points.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near.append(np.argsort(d, 1, kind="stable")[:, : max(1, min(DEGREE, k - 1))])
    far = np.random.default_rng(seed).integers(0, k, (k, 4))
    return Centroids(points, np.hstack([np.concatenate(near) % k, far]), longest, dim)


def _assign(index, beam: int):
    """Each vector's lists: the nearest, and those of which it is on the boundary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Centroids = index.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                x = g.lifted(matrix(pa.chunked_array([part.column("v")]), g.dim))
                view, d = g.search(x, beam)
                d = np.sqrt(d)
                mine = np.zeros(view.shape, bool)
                for j in range(min(view.shape[1], 4 * REPLICAS)):
                    fits = (d[:, j] <= NEAR * d[:, 0] + 1e-12) & (mine.sum(1) < REPLICAS)
                    for i in range(j):
                        apart = np.sqrt(((g.points[view[:, i]] - g.points[view[:, j]]) ** 2).sum(1))
                        fits &= ~mine[:, i] | (apart >= d[:, j])
                    mine[:, j] = fits
                mine[:, 0] = True
                r, c = np.nonzero(mine)
                yield pa.RecordBatch.from_arrays([part.column("nr").take(pa.array(r)), pa.array(view[r, c], pa.int32())], ["nr", "list"])

    return run


def _select(index, beam: int, ratio: float):
    """Each query's lists, by the ratio of the centroids' distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Centroids = index.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                view, d = g.search(g.aimed(matrix(pa.chunked_array([part.column("v")]), g.dim)), beam)
                r, c = np.nonzero((d <= ratio**2 * d[:, :1] + 1e-12) | (np.arange(d.shape[1]) < LEAST))
                yield pa.RecordBatch.from_arrays([part.column("nr").take(pa.array(r)), pa.array(view[r, c], pa.int32())], ["nr", "list"])

    return run


def _score(k: int, dim: int):
    """The k best of one part of a list for each query that reads it."""

    def run(cands: pa.Table, asks: pa.Table) -> pa.Table:
        names = {"qv": [], "cv": [], "score": []}
        if len(cands) and len(asks):
            v, first, cv = matrix(cands.column("v"), dim), np.asarray(cands.column("first")), np.asarray(cands.column("nr"))
            q_all, qv = matrix(asks.column("v"), dim), np.asarray(asks.column("nr"))
            for at in range(0, len(q_all), 256):
                q = q_all[at:at + 256]
                score = np.zeros((len(q), len(v)))
                for j in range(dim):  # in order of the components, so equal vectors have equal scores
                    score += q[:, j, None] * v[:, j]
                order = np.lexsort((np.broadcast_to(first, score.shape), -score))[:, :k]
                names["qv"].append(np.repeat(qv[at:at + 256], order.shape[1]))
                names["cv"].append(cv[order].ravel())
                names["score"].append(np.take_along_axis(score, order, 1).ravel())
        kinds = {"qv": np.int64, "cv": np.int64, "score": np.float64}
        return pa.table({n: np.concatenate(a) if a else np.empty(0, kinds[n]) for n, a in names.items()})

    return run


def build_index(distinct: DataFrame) -> Centroids | None:
    """Centroids and their graph for the distinct vectors (nr, v)."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, dim, longest = distinct.agg(F.count("*"), F.max(F.size("v")), F.max(norm2)).first()
    if not n:
        return None
    lists = max(1, min(MOST_LISTS, n // LIST))
    size = min(SAMPLE, 16 * lists, n)
    # nr is a hash, so the smallest are a fair sample; a share of the rows is enough to choose them from
    share = F.pmod(F.xxhash64("nr"), F.lit(max(1, n // (4 * size)))) == 0
    sample = distinct.filter(share).select("nr", "v").orderBy("nr").limit(size).toArrow()
    x = matrix(sample.column("v"), dim)
    bare = Centroids(np.zeros((1, dim + 1)), np.zeros((1, 1), int), float(np.sqrt(longest)), dim)
    return with_graph(balanced_centroids(bare.lifted(x), lists), bare.longest, dim)


def nearest(rows: DataFrame, k: int = 20, every: int = 20, ratio: float = RATIO, beam: int = BEAM, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by
    `every`, the k rows of largest inner product found, but its own."""
    spark = rows.sparkSession
    zero = F.forall(F.col(column), lambda x: x == 0)
    rows = stored(rows.filter(F.col("vec_id").isNotNull() & finite(F.col(column)) & ~zero)
                  .select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v")), "vectors")
    distinct = stored(distinct_vectors(rows, k, every).withColumn("nr", F.xxhash64("v")), "distinct")
    index = build_index(distinct)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)  # MOST_LISTS centroids at most
    lists = stored(distinct.select("nr", "v").mapInArrow(_assign(shared, 32), "nr long, list int"), "lists")
    reads = distinct.filter("asks").select("nr", "v").mapInArrow(_select(shared, beam, ratio), "nr long, list int")
    parts = lists.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # a row per list
    cands = (lists.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("nr"), F.col("parts")).cast("int"))
             .join(distinct.select("nr", "v", F.col("ids")[0].alias("first")), "nr").select("list", "part", "nr", "v", "first"))
    asks = (reads.join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .join(distinct.filter("asks").select("nr", "v"), "nr").select("list", "part", "nr", "v"))
    hits = cands.groupBy("list", "part").cogroup(asks.groupBy("list", "part")).applyInArrow(_score(k + OWN, index.dim), "qv long, cv long, score double")
    return answers(hits.dropDuplicates(["qv", "cv"]), distinct, rows, k, every)
