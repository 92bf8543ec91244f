"""Vectors as blocks: rows of a table of vectors, packed so that tasks work on
matrices.  Shared by the two nearest-neighbour searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A query's own row may be among the best, so one id more than k is kept.
OWN = 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def distinct_vectors(rows: DataFrame, k: int, every: int) -> DataFrame:
    """Rows (vec_id, v) as one row per distinct vector: v, `ids` (its k + 1
    smallest ids, which is all that k places can hold besides the query's
    own) and `asks`, whether a query has it.  A vector that many rows share is
    combined before the shuffle; the many ids are met again at the end."""
    some = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + OWN)
    part = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(256))).groupBy("v", "part").agg(
        some.alias("ids"), F.max(F.coalesce(F.col("vec_id") % every == 0, F.lit(False))).alias("asks"))
    return part.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + OWN).alias("ids"), F.max("asks").alias("asks"))


def matrix(column: pa.ChunkedArray, dim: int, kind: type = np.float64) -> np.ndarray:
    """A column of vectors as rows; shorter ones end in zeros."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    if (lengths == dim).all():
        return flat.reshape(len(column), dim).astype(kind)
    out = np.zeros((len(column), dim), kind)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def answers(hits: DataFrame, distinct: DataFrame, rows: DataFrame, k: int, every: int) -> DataFrame:
    """From `hits` (qv, cv, score: numbers of the asking and the found distinct
    vector, each pair once) the k best rows of each query row but its own, ties
    to the smaller id: query_id, rank, vec_id, score."""
    best = Window.partitionBy("qv").orderBy(F.desc("score"), F.col("first"))
    found = (hits.join(distinct.select(F.col("nr").alias("cv"), "ids"), "cv").withColumn("first", F.col("ids")[0])
             .withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + OWN))
    # k + 1 smallest by score, then id, over the ids of the best vectors
    flat = found.select("qv", F.explode("ids").alias("vec_id"), "score")
    order = Window.partitionBy("qv").orderBy(F.desc("score"), "vec_id")
    top = (flat.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + OWN)
           .groupBy("qv").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("top")))
    asking = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    mine = asking.join(distinct.select("v", F.col("nr").alias("qv")), "v").join(top, "qv")
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(others).alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))
