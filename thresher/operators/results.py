"""Analytics over the stored rule results.

The results table keeps every version of a (rule, group, window) row; the
latest version wins (a final row over a partial one, then the newer one).
`latest_versions` is one hash aggregate with `max_by`, so a key with a
billion versions is combined map-side.  A listing is complete unless a limit
is asked for (then the newest windows, by TakeOrderedAndProject); the ranked-groups report
aggregates per group first, so its cap applies to ranked groups, not rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thresher.functions.timeutil import (
    LOCAL_OFFSET_MINUTES, local_text_of, ntz_literal, parse_lenient_text, parse_local_text_col,
)
from thresher.spec import clamp

KEY = ["ruleId", "groupKey", "windowStart"]
LIVE_MAX = 1000
TOP_DEFAULT, TOP_MAX = 50, 200


def latest_versions(results: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row per key: the final version if any, else the newest by
    producedAt; `seq` breaks remaining ties."""
    others = [c for c in results.columns if c not in key]
    order = F.struct(F.col("isFinal"), F.col("producedAt"), F.col("seq"))
    best = F.max_by(F.struct(*[F.col(c) for c in others]), order).alias("__r")
    return results.groupBy(*key).agg(best).select(*key, *[F.col(f"__r.{c}").alias(c) for c in others])


def _window_start_ts(df: DataFrame) -> Column:
    return parse_local_text_col(F.col("windowStart"))


def window_start_between(lo: dt.datetime | None, hi: dt.datetime | None) -> Column:
    """windowStart (local 'yyyy-MM-dd HH:mm:ss' text) in [lo, hi] (naive UTC,
    None = open).  The fixed-width text sorts like time, so a plain text
    range goes first -- it reaches the Parquet scan and skips row groups --
    and the exact comparison on the parsed time follows (unparseable text
    never matches)."""
    ws = parse_local_text_col(F.col("windowStart"))
    pred = ws.isNotNull()
    if lo is not None:
        pred = (F.col("windowStart") >= F.lit(local_text_of(lo))) & pred & (ws >= ntz_literal(lo))
    if hi is not None:
        pred = (F.col("windowStart") <= F.lit(local_text_of(hi))) & pred & (ws <= ntz_literal(hi))
    return pred


def _bounds(start_text: str, end_text: str) -> tuple[dt.datetime | None, dt.datetime | None, bool]:
    lo, hi = parse_lenient_text(start_text), parse_lenient_text(end_text)
    return lo, hi, lo is not None and hi is not None

def normalised_rule_id(col: Column) -> Column:
    """Empty or missing rule id -> 'unknown'."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit("unknown"))


def newest_windows(df: DataFrame, limit: int | None) -> DataFrame:
    """All rows, or with a limit the newest windows."""
    if limit is None:
        return df
    return df.orderBy(F.col("windowStart").desc(), F.col("ruleId").asc(), F.col("groupKey").asc()).limit(limit)


def live_results(results: DataFrame, rule_id: str, limit: int | None = None) -> DataFrame:
    """Latest versions of one rule; with a limit (1..1000, else an error), the
    newest windows first."""
    if limit is not None and not 1 <= limit <= LIVE_MAX:
        raise ValueError(f"limit must be between 1 and {LIVE_MAX}")
    return newest_windows(latest_versions(results.where(F.col("ruleId") == rule_id)), limit)


def results_last_hours(results: DataFrame, rule_ids: list[str] | None, hours: int, now: dt.datetime,
                       limit: int | None = None) -> DataFrame:
    """Latest versions whose window started in the last `hours` before `now`
    (naive UTC), for some rules or (empty list) all rules, rule id normalised;
    with a `limit`, the newest windows across rules."""
    since = now - dt.timedelta(hours=hours)
    df = results if not rule_ids else results.where(F.col("ruleId").isin(rule_ids))
    df = latest_versions(df.where(window_start_between(since, None)))
    return newest_windows(df, limit).withColumn("ruleId", normalised_rule_id(F.col("ruleId")))


def results_in_range(results: DataFrame, rule_ids: list[str], start_text: str, end_text: str,
                     limit: int | None = None) -> DataFrame:
    """Latest versions of the given rules whose window start lies in the
    closed range (lenient text); with a `limit`, the newest across rules."""
    lo, hi, ok = _bounds(start_text, end_text)
    if not rule_ids or not ok:
        return results.limit(0)
    df = results.where(F.col("ruleId").isin(rule_ids) & window_start_between(lo, hi))
    return newest_windows(latest_versions(df), limit).withColumn("ruleId", normalised_rule_id(F.col("ruleId")))


def group_detail(results: DataFrame, rule_id: str, group_key: str, start_text: str, end_text: str,
                 limit: int | None = None) -> DataFrame:
    """One group's window history in range; with a `limit`, the newest."""
    lo, hi, ok = _bounds(start_text, end_text)
    if not ok:
        return results.limit(0)
    df = results.where((F.col("ruleId") == rule_id) & (F.col("groupKey") == group_key) & window_start_between(lo, hi))
    return newest_windows(latest_versions(df), limit)


def top_groups(results: DataFrame, rule_id: str, start_text: str, end_text: str,
               limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Rank one rule's groups by breached windows, then total windows
    (groupKey breaks ties), with paging: limit 1..200 default 50, offset
    >= 0 default 0.  breachRate is a percentage, 0 without windows."""
    n = clamp(limit, 1, TOP_MAX, TOP_DEFAULT)
    off = 0 if offset is None or offset < 0 else int(offset)
    lo, hi, ok = _bounds(start_text, end_text)
    df = latest_versions(results.where((F.col("ruleId") == rule_id) & window_start_between(lo, hi)))
    if not ok:
        df = df.limit(0)
    per_group = df.groupBy("groupKey").agg(
        F.count(F.lit(1)).alias("totalWindows"),
        F.sum(F.col("thresholdBreached").cast("long")).alias("breachedWindows"),
        F.max("windowEnd").alias("lastSeen"),
    )
    rate = F.when(F.col("totalWindows") > 0,
                  F.col("breachedWindows") / F.col("totalWindows") * F.lit(100.0)).otherwise(F.lit(0.0))
    ranked = per_group.select("groupKey", "totalWindows", "breachedWindows", rate.alias("breachRate"), "lastSeen")
    ordered = ranked.orderBy(F.col("breachedWindows").desc(), F.col("totalWindows").desc(), F.col("groupKey").asc())
    return ordered.offset(off).limit(n) if off else ordered.limit(n)


__all__ = ["latest_versions", "live_results", "results_last_hours", "results_in_range", "group_detail",
           "top_groups", "normalised_rule_id", "LOCAL_OFFSET_MINUTES"]
