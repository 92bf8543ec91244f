"""Breakdowns of the events a rule matches, over the whole range.

Four summaries share one set of matched rows: a modality mix (sums of 0/1
flags), an outcome count, a location hotspot and a score histogram.  Each is
a single hash aggregate with map-side combine; the top-k ones end in
TakeOrderedAndProject.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher.functions.timeutil import number_text
from thresher.operators.backtest import rule_matches
from thresher.sources.events import STANDIN_SOURCE, EventSource

TOP_K = 10
UNKNOWN = "UNKNOWN"


def modality_mix(matched: DataFrame, flags: list[tuple[str, str]]) -> DataFrame:
    """(label, count) per flag column: the rounded sum of the 0/1 flag over
    the matched rows, 0 when none match.  One aggregate, then an unpivot."""
    sums = matched.agg(*[
        F.rint(F.coalesce(F.sum(F.col(c)), F.lit(0.0))).cast("long").alias(f"__m{i}")
        for i, (_, c) in enumerate(flags)
    ])
    pairs = ", ".join(f"'{label}', __m{i}" for i, (label, _) in enumerate(flags))
    return sums.selectExpr(f"stack({len(flags)}, {pairs}) AS (label, count)")


def category_top(matched: DataFrame, label: Column, k: int = TOP_K) -> DataFrame:
    """Top-k labels by row count (null label -> UNKNOWN), ties by label."""
    counts = matched.groupBy(F.coalesce(label.cast("string"), F.lit(UNKNOWN)).alias("label")) \
        .agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), F.col("label").asc()).limit(k)


def location_top(matched: DataFrame, key_col: str, locations: DataFrame, loc_key: str, loc_label: str,
                 k: int = TOP_K, places: DataFrame | None = None, place_key: str | None = None,
                 place_label: str | None = None, max_broadcast_rows: int = 100_000) -> DataFrame:
    """Top-k locations of the matched rows.

    The location comes from a dimension join (entity -> location [-> place
    name]).  Matched rows are counted per entity first, so the join sees one
    row per entity however hot it is; entities without a location count as
    UNKNOWN (left joins).
    """
    per_entity = matched.groupBy(F.col(key_col).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    loc = locations.select(F.col(loc_key).alias("__k"), F.col(loc_label).alias("__loc"))
    joined = per_entity.join(loc, "__k", "left")
    if places is not None:
        names = places.select(F.col(place_key).alias("__loc"), F.col(place_label).alias("__name"))
        joined = joined.join(names, "__loc", "left").withColumn("__loc", F.col("__name"))
    counts = joined.groupBy(F.coalesce(F.col("__loc").cast("string"), F.lit(UNKNOWN)).alias("label")) \
        .agg(F.sum("__n").alias("count"))
    return counts.orderBy(F.col("count").desc(), F.col("label").asc()).limit(k)


def score_histogram(matched: DataFrame, score_col: str, width: float = 10.0) -> DataFrame:
    """Buckets of `width` over a score, nulls excluded, ordered by bucket;
    labels are double text ('50.0-60.0')."""
    b = (F.floor(F.col(score_col) / width).cast("double") * F.lit(width)).alias("bucket_start")
    counts = matched.where(F.col(score_col).isNotNull()).groupBy(b).agg(F.count(F.lit(1)).alias("count"))
    label = F.concat_ws("-", *(number_text(c, T.DoubleType()) for c in (F.col("bucket_start"), F.col("bucket_start") + F.lit(width))))
    return counts.select(label.alias("label"), "count", "bucket_start").orderBy("bucket_start")


# Fixed values (stand-in): modality labels and their flag columns.
STANDIN_FLAGS = [("Signup", "flag_signup"), ("Purchase", "flag_purchase"), ("Error", "flag_error"),
                 ("View", "flag_view"), ("Click", "flag_click")]
