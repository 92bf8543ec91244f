"""Backtest plans: windows, groups, aggregates, thresholds, dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from thresher.functions.timeutil import days_back_range, local_text_of, ntz_text, resolve_range
from thresher.operators.backtest import backtest
from thresher.plans.common import (
    DEDUP_SQL, FLAGSHIP_RULE, MATCHED_SQL, NOW_UTC, cond, events, group, local_sql, rule, whole_range,
)
from thresher.plans.registry import register, rounded
from thresher.sources.events import STANDIN_SOURCE, flatten_message, latest_deliveries, matched_events, nested_events


def _bt(spark, sf_dir, doc, ev=None):
    ev = events(spark, sf_dir) if ev is None else ev
    return rounded(backtest(ev, doc, *whole_range(ev)))


def flagship(spark, sf_dir):
    return _bt(spark, sf_dir, FLAGSHIP_RULE)


register("backtest_user_daily", covers="A1-A7 A9 A11 O1 C1 F2 F4 F8", sql=f"""
SELECT {local_sql('ws')} AS window_start, groupKey, cnt, round(total, 4) AS total,
       COALESCE(cnt >= 2 AND total > 20, false) AS threshold_met
FROM (SELECT time_bucket(INTERVAL '86400 seconds', ts) AS ws, COALESCE(CAST(user_id AS VARCHAR), 'N/A') AS groupKey,
             COUNT(event_id) AS cnt, SUM(value) AS total
      FROM {MATCHED_SQL} m WHERE event_type IN ('purchase', 'click') AND value > 5
      GROUP BY ws, user_id) g""")(flagship)


WEEKLY_RULE = rule(
    "R_GLOBAL_WEEK", ["__GLOBAL__"], 604800000,
    [("n", "event_id", "COUNT"), ("users", "user_id", "COUNT_DISTINCT"),
     ("avg_value", "value", "AVG"), ("mx", "value", "MAX")],
    "n > 1000 || avg_value >= 50",
    cond("event_type", "NOT_EQUALS", "view"),
)


@register("backtest_global_weekly", covers="A10 V1 V3 A3 A5 A7 F3", sql=f"""
SELECT {local_sql('ws')} AS window_start, '__GLOBAL__' AS groupKey, n, users, round(avg_value, 4) AS avg_value,
       round(mx, 4) AS mx, COALESCE(n > 1000 OR avg_value >= 50, false) AS threshold_met
FROM (SELECT time_bucket(INTERVAL '604800 seconds', ts) AS ws, COUNT(event_id) AS n,
             COUNT(DISTINCT user_id) AS users, AVG(value) AS avg_value, MAX(value) AS mx
      FROM {MATCHED_SQL} m WHERE event_type != 'view' GROUP BY ws) g""")
def global_weekly(spark, sf_dir):
    return _bt(spark, sf_dir, WEEKLY_RULE)


MULTI_KEY_RULE = rule(
    "R_MULTI", ["event_type", "_data.k"], 3600000,
    [("mn", "value", "MIN"), ("mx", "value", "MAX"), ("users", "user_id", "COUNT_DISTINCT")],
    "mx - mn > 100",
)


@register("backtest_multi_key_nulls", covers="A9 V7 A6 A7 S2", sql=f"""
WITH ev AS (SELECT event_id, ts, user_id, NULLIF(event_type, 'error') AS event_type, value, props FROM events),
d AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '3600 seconds', ts)
                                                 ORDER BY event_id DESC NULLS LAST) = 1),
m AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM d
      WHERE ts IS NOT NULL),
g AS (SELECT time_bucket(INTERVAL '3600 seconds', ts) AS ws,
             COALESCE(CAST(event_type AS VARCHAR), 'N/A') || '|' || COALESCE(CAST(k AS VARCHAR), 'N/A') AS groupKey,
             MIN(value) AS mn, MAX(value) AS mx, COUNT(DISTINCT user_id) AS users
      FROM m GROUP BY ws, event_type, k)
SELECT {local_sql('ws')} AS window_start, groupKey, round(mn, 4) AS mn, round(mx, 4) AS mx, users,
       COALESCE(mx - mn > 100, false) AS threshold_met
FROM g""")
def multi_key_nulls(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("event_type", F.nullif(F.col("event_type"), F.lit("error")))
    return _bt(spark, sf_dir, MULTI_KEY_RULE, ev)


LOGIC_RULE = rule(
    "R_LOGIC", ["event_type"], 86400000,
    [("cnt", "event_id", "COUNT"), ("total", "value", "SUM"), ("low", "value", "MIN")],
    "total / (cnt - 66) > 300 || NOT (low < 0.5) && cnt != 60",
)


@register("backtest_threshold_logic", covers="A11 V8 V9 A6", sql=f"""
SELECT {local_sql('ws')} AS window_start, groupKey, cnt, round(total, 4) AS total, round(low, 4) AS low,
       COALESCE((total / NULLIF(cnt - 66, 0) > 300) OR (NOT (low < 0.5) AND cnt != 60), false) AS threshold_met
FROM (SELECT time_bucket(INTERVAL '86400 seconds', ts) AS ws, COALESCE(CAST(event_type AS VARCHAR), 'N/A') AS groupKey,
             COUNT(event_id) AS cnt, SUM(value) AS total, MIN(value) AS low
      FROM {MATCHED_SQL} m GROUP BY ws, event_type) g""")
def threshold_logic(spark, sf_dir):
    return _bt(spark, sf_dir, LOGIC_RULE)


CASE_RULE = rule(
    "R_CASE", ["event_type"], 86400000,
    [("cnt", "event_id", "COUNT"), ("total", "value", "SUM")],
    "CASE WHEN cnt > 65 THEN total / cnt > 60 ELSE total > 3000 END",
)


@register("backtest_threshold_case", covers="A11 C5", sql=f"""
SELECT {local_sql('ws')} AS window_start, groupKey, cnt, round(total, 4) AS total,
       COALESCE(CASE WHEN cnt > 65 THEN total / NULLIF(cnt, 0) > 60 ELSE total > 3000 END, false) AS threshold_met
FROM (SELECT time_bucket(INTERVAL '86400 seconds', ts) AS ws, COALESCE(CAST(event_type AS VARCHAR), 'N/A') AS groupKey,
             COUNT(event_id) AS cnt, SUM(value) AS total
      FROM {MATCHED_SQL} m GROUP BY ws, event_type) g""")
def threshold_case(spark, sf_dir):
    return _bt(spark, sf_dir, CASE_RULE)


REJECTED_RULE = rule(
    "R_REJECT", ["user_id"], 604800000,
    [("Total", "value", "SUM"), ("cnt", "event_id", "unknown_fn")],
    "Total > 1 && cnt > 1e5",
)


@register("backtest_threshold_rejected", covers="V10 V11 A8", sql=f"""
SELECT {local_sql('ws')} AS window_start, groupKey, round(total, 4) AS total, cnt, false AS threshold_met
FROM (SELECT time_bucket(INTERVAL '604800 seconds', ts) AS ws, COALESCE(CAST(user_id AS VARCHAR), 'N/A') AS groupKey,
             SUM(value) AS total, COUNT(event_id) AS cnt
      FROM {MATCHED_SQL} m GROUP BY ws, user_id) g""")
def threshold_rejected(spark, sf_dir):
    return _bt(spark, sf_dir, REJECTED_RULE)


@register("dedup_latest_event", covers="S3 W1 V21", sql=f"""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, round(value, 4) AS value
FROM {DEDUP_SQL} d""")
def dedup_latest_event(spark, sf_dir):
    d = latest_deliveries(events(spark, sf_dir), STANDIN_SOURCE)
    return rounded(d.select("event_id", ntz_text(F.col("ts"), micros=True).alias("ts"),
                            "user_id", "event_type", "value"))


@register("event_time_through_dedup", covers="F18 S3 V4 V5", sql=f"""
SELECT event_type, COUNT(*) AS n, round(SUM(value), 4) AS total
FROM {DEDUP_SQL} d
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:15:00'
GROUP BY event_type""")
def event_time_through_dedup(spark, sf_dir):
    start, end = resolve_range("2024-01-10T05:30", "2024-01-20 17:45:00")
    m = matched_events(events(spark, sf_dir), STANDIN_SOURCE, start, end)
    return rounded(m.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@register("json_payload_projection", covers="S2 S9 C15", sql="""
SELECT event_id, user_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events""")
def json_payload_projection(spark, sf_dir):
    msg = nested_events(events(spark, sf_dir))
    flat = flatten_message(msg)
    return flat.select("event_id", "user_id", "event_type", "k")


@register("backtest_days_back", covers="O10 V5 A1", sql=f"""
SELECT {local_sql('ws')} AS window_start, groupKey, cnt, round(total, 4) AS total,
       COALESCE(cnt >= 2 AND total > 20, false) AS threshold_met
FROM (SELECT time_bucket(INTERVAL '86400 seconds', ts) AS ws, COALESCE(CAST(user_id AS VARCHAR), 'N/A') AS groupKey,
             COUNT(event_id) AS cnt, SUM(value) AS total
      FROM {DEDUP_SQL} d
      WHERE ts BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'
        AND event_type IN ('purchase', 'click') AND value > 5
      GROUP BY ws, user_id) g""")
def backtest_days_back(spark, sf_dir):
    """The last N days (1..90, default 7; 500 is out of range -> 7) before
    `now`, as the historical-test endpoint computes it."""
    start, end = days_back_range(500, NOW_UTC)
    return rounded(backtest(events(spark, sf_dir), FLAGSHIP_RULE, local_text_of(start), local_text_of(end)))


AMOUNT_RULE = rule("R_AMOUNT", ["amount"], 86400000, [("cnt", "event_id", "COUNT")], "cnt >= 2",
                   cond("amount", "CONTAINS", "00000.0"))


@register("backtest_double_keys", covers="V16 A9 F10", sql=f"""
WITH ev AS (SELECT *, FLOOR(value) * 100000.0 AS amount FROM {MATCHED_SQL} m)
SELECT {local_sql('ws')} AS window_start, groupKey, cnt, COALESCE(cnt >= 2, false) AS threshold_met
FROM (SELECT time_bucket(INTERVAL '86400 seconds', ts) AS ws, COALESCE(CAST(amount AS VARCHAR), 'N/A') AS groupKey,
             COUNT(event_id) AS cnt
      FROM ev WHERE contains(CAST(amount AS VARCHAR), '00000.0') GROUP BY ws, amount) g""")
def backtest_double_keys(spark, sf_dir):
    """Group keys and text filters over doubles of 1e7 and more print as
    plain decimals ('15000000.0')."""
    ev = events(spark, sf_dir).withColumn("amount", F.floor("value") * F.lit(100000.0))
    return _bt(spark, sf_dir, AMOUNT_RULE, ev)
