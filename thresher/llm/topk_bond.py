"""Exact top-k by inner product: columnar branch-and-bound.

Vectors become integers, floor(64 x) per component.  Distinct vectors are
dealt into tiles of candidates and queries (the query set against all rows, in
blocks; the tiles are the only thing that is repeated).  In a tile, candidates
lie by dimension: scores grow dimension block by block, the heaviest dimensions
first, and after each block candidates whose score plus the largest product of
the masses that remain can't reach any query's k-th best are dropped and the
rest compacted.  Sums are integers held in doubles, exact below 2^53; a tile
that could go beyond is computed with Python's integers, and a score that fits
no long is the nearest long.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part, nor do rows without an id; shorter vectors are read as ending in
zeros, so an empty one is the zero vector; equal vectors are searched once and
all their rows are met again in the answer; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thresher.llm.shared import stored
from thresher.llm.vectors import OWN, answers, distinct_vectors, finite, matrix

CANDIDATES = 8192  # of a tile
QUERIES = 1024
TOGETHER = 32  # queries that share a compaction
RUN = 4096  # candidates that share one
DIMS = 8


def _best(score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((first, -score))[:k]


def tile_search(queries: np.ndarray, vectors: np.ndarray, first: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query: places of its k best candidates (ties to the smaller
    `first`) and their scores."""
    order = np.argsort(-(vectors * vectors).sum(0), kind="stable")
    queries, vertical = queries[:, order], np.ascontiguousarray(vectors[:, order].T)
    cuts = [*range(0, len(order), DIMS), len(order)]
    mass = lambda a, axis: np.sqrt(np.stack([(a[c:] ** 2 if axis == 0 else a[:, c:] ** 2).sum(axis) for c in cuts[1:]]))
    left_q, left_v = mass(queries, 1) * (1 + 1e-9), mass(vertical, 0) * (1 + 1e-9)
    out = []
    for q0 in range(0, len(queries), TOGETHER):
        q = queries[q0:q0 + TOGETHER]
        level = np.full(len(q), -np.inf)
        top = [(np.empty(0, np.int64), np.empty(0)) for _ in q]
        for c0 in range(0, vertical.shape[1], RUN):
            live = np.arange(c0, min(c0 + RUN, vertical.shape[1]))
            sums = np.zeros((len(q), len(live)))
            for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                sums += q[:, lo:hi] @ vertical[lo:hi, live]
                can = (sums + left_q[b, q0:q0 + TOGETHER, None] * left_v[b, live] >= level[:, None]).any(0)
                if can.mean() < 0.8:
                    live, sums = live[can], sums[:, can]
                if not len(live):
                    break
            if not len(live):
                continue
            for i in range(len(q)):
                hit = np.flatnonzero(sums[i] >= level[i])
                if len(hit):
                    where, score = np.append(top[i][0], live[hit]), np.append(top[i][1], sums[i, hit])
                    keep = _best(score, first[where], k)
                    top[i] = where[keep], score[keep]
                    if len(keep) == k:
                        level[i] = score[keep[-1]]
        out += top
    return out


def _in_integers(queries: np.ndarray, vectors: np.ndarray, first: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for q in queries.astype(object):
        score = (vectors.astype(object) * q).sum(1)
        keep = sorted(range(len(score)), key=lambda i: (-score[i], first[i]))[:k]
        out.append((np.array(keep, np.int64), np.array([min(max(int(score[i]), -(1 << 63)), (1 << 63) - 1) for i in keep], object)))
    return out


def _tile(k: int, dim: int):
    def run(cands: pa.Table, asks: pa.Table) -> pa.Table:
        empty = pa.table({"qv": pa.array([], pa.int64()), "cv": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not len(cands) or not len(asks):
            return empty
        v, q = matrix(cands.column("v"), dim, np.int64), matrix(asks.column("v"), dim, np.int64)
        first = np.asarray(cands.column("first"))
        largest = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) * max(dim, 1)
        found = (tile_search(q.astype(float), v.astype(float), first, k) if largest < 2.0 ** 52 else _in_integers(q, v, first, k))
        qv, cv = np.asarray(asks.column("nr")), np.asarray(cands.column("nr"))
        return pa.table({"qv": pa.array(np.repeat(qv, [len(w) for w, _ in found])), "cv": pa.array(np.concatenate([cv[w] for w, _ in found])),
                         "score": pa.array([int(s) for _, ss in found for s in ss], pa.int64())})

    return run


def quantised(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers."""
    exact = F.transform(F.col(column), lambda x: F.floor(x.cast("double") * 64).cast("long"))
    return rows.filter(F.col("vec_id").isNotNull() & finite(F.col(column))).select(F.col("vec_id").cast("long").alias("vec_id"), exact.alias("v"))


def exact_topk(rows: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by
    `every`, the k rows of highest integer inner product but its own."""
    rows = stored(quantised(rows), "vectors")
    distinct = stored(distinct_vectors(rows, k, every).withColumn("nr", F.xxhash64("v")), "distinct")
    n, asking, dim = distinct.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first()
    c_tiles, q_tiles = max(1, -(-n // CANDIDATES)), max(1, -(-(asking or 0) // QUERIES))
    tile = lambda tiles: F.pmod(F.xxhash64("nr"), F.lit(tiles)).cast("int")
    every_tile = lambda tiles: F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    cands = distinct.select("nr", "v", F.col("ids")[0].alias("first"), tile(c_tiles).alias("c"), every_tile(q_tiles).alias("q"))
    asks = distinct.filter("asks").select("nr", "v", tile(q_tiles).alias("q"), every_tile(c_tiles).alias("c"))
    hits = cands.groupBy("c", "q").cogroup(asks.groupBy("c", "q")).applyInArrow(_tile(k + OWN, dim or 0), "qv long, cv long, score long")
    return answers(hits, distinct, rows, k, every)


__all__ = ["exact_topk", "quantised", "tile_search"]
