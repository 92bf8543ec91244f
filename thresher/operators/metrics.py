"""Consumption-delay histogram of result messages.

delay = consumption time - producedAt (local text), clamped at 0; messages
whose producedAt does not parse are skipped.  Buckets are cumulative
(`le`), like a Prometheus histogram.  One aggregate with one conditional
count per bucket, then an unpivot -- no join, no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thresher.functions.timeutil import text_to_ntz

# The default latency buckets, in seconds.
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)


def delay_seconds(produced_text: str, consumed_text: str) -> F.Column:
    produced = text_to_ntz(F.col(produced_text))
    consumed = text_to_ntz(F.col(consumed_text))
    micros = F.timestamp_diff("MICROSECOND", produced, consumed)
    return F.greatest(F.lit(0.0), micros.cast("double") / F.lit(1e6))


def delay_histogram(df: DataFrame, topic_col: str, produced_col: str, consumed_col: str,
                    buckets=DEFAULT_BUCKETS) -> DataFrame:
    produced_ok = text_to_ntz(F.col(produced_col)).isNotNull()
    d = df.where(produced_ok).select(F.col(topic_col).alias("topic"),
                                     delay_seconds(produced_col, consumed_col).alias("delay"))
    aggs = [F.count(F.when(F.col("delay") <= F.lit(float(b)), 1)).alias(f"__b{i}") for i, b in enumerate(buckets)]
    aggs.append(F.count(F.lit(1)).alias(f"__b{len(buckets)}"))
    per_topic = d.groupBy("topic").agg(*aggs)
    labels = [str(b) for b in buckets] + ["+Inf"]
    pairs = ", ".join(f"'{lab}', __b{i}" for i, lab in enumerate(labels))
    return per_topic.selectExpr("topic", f"stack({len(labels)}, {pairs}) AS (le, count)")
