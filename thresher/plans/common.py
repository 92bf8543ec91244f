"""Parameters shared by the registered plans and their oracle SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.sources.events import read_table

# "now" for plans that look back from the present (fixed so runs repeat).
NOW_UTC = dt.datetime(2024, 1, 31, 0, 0, 0)

# Dedup of the stand-in events: newest event_id per (user_id, hour of ts).
DEDUP_SQL = """(SELECT * FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '3600 seconds', ts)
                             ORDER BY event_id DESC NULLS LAST) = 1)"""

# Flat view of deduplicated events in the range (payload field and flags).
MATCHED_SQL = f"""(SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CAST(event_type = 'signup' AS DOUBLE) AS flag_signup,
    CAST(event_type = 'purchase' AS DOUBLE) AS flag_purchase,
    CAST(event_type = 'error' AS DOUBLE) AS flag_error,
    CAST(event_type = 'view' AS DOUBLE) AS flag_view,
    CAST(event_type = 'click' AS DOUBLE) AS flag_click
  FROM {DEDUP_SQL} d
  WHERE ts IS NOT NULL)"""


def local_sql(expr: str) -> str:
    """SQL for 'timestamp -> local +05:30 text'."""
    return f"strftime({expr} + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S')"


def whole_range(ev: DataFrame) -> tuple[str, str]:
    """A request range (local text, whole minutes, as a user would send it)
    that holds every event of the table."""
    first, last = ev.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        first = last = NOW_UTC
    return tuple((t + dt.timedelta(minutes=330 + more)).strftime("%Y-%m-%d %H:%M") for t, more in ((first, 0), (last, 1)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def rule(rule_id: str, keys, size_ms, aggs, threshold="", filters=None, **extra) -> dict:
    """Rule document in the editor's JSON shape."""
    doc = {
        "rule_metadata": {"rule_id": rule_id, "status": "DRAFT", "severity_level": "HIGH",
                          "penalty_ttl_seconds": 0},
        "filters": filters,
        "grouping": {"keys": list(keys)},
        "windowing": {"type": "TUMBLING", "size_ms": size_ms, "slide_ms": size_ms},
        "aggregations": [{"alias": a, "field": f, "function": fn} for a, f, fn in aggs],
        "having_thresholds": {"expression": threshold},
    }
    doc.update(extra)
    return doc


def cond(field: str, op: str, value=None, fmt: str | None = None) -> dict:
    node = {"type": "condition", "field": field, "operator": op}
    if value is not None:
        node["value"] = value
    if fmt is not None:
        node["format"] = fmt
    return node


def group(logic: str, *conditions) -> dict:
    return {"type": "group", "logic": logic, "conditions": list(conditions)}


# The flagship rule: at least 2 purchases or clicks above 5 totalling over 20
# in one day, per user.
FLAGSHIP_RULE = rule(
    "R1", ["user_id"], 86400000,
    [("cnt", "event_id", "COUNT"), ("total", "value", "SUM")],
    "cnt >= 2 && total > 20",
    group("AND", cond("event_type", "IN", "purchase, click"), cond("value", "GREATER_THAN", 5)),
)


# The live evaluator's message stream, derived from events the same way
# `thresher.sources.results.standin_messages` does (running count and sum
# per rule, group and window in event order; the last event's row is final;
# early-fire rows of error events are re-delivered 500 events late).
MESSAGES_CTE = f"""
d AS {DEDUP_SQL},
u AS (
  SELECT 'R_USER_DAY' AS ruleId, 0 AS ridx, COALESCE(CAST(user_id AS VARCHAR), 'N/A') AS groupKey,
         time_bucket(INTERVAL '86400 seconds', ts) AS ws, INTERVAL 86400 SECOND AS width,
         event_id, ts, value, event_type
  FROM d WHERE event_type IN ('purchase', 'click') AND value > 5
  UNION ALL
  SELECT 'R_TYPE_HOUR', 1, COALESCE(CAST(event_type AS VARCHAR), 'N/A'),
         time_bucket(INTERVAL '3600 seconds', ts), INTERVAL 3600 SECOND, event_id, ts, value, event_type
  FROM d),
r AS (
  SELECT *, COUNT(event_id) OVER w AS cnt, SUM(value) OVER w AS total_raw,
         event_id = MAX(event_id) OVER (PARTITION BY ruleId, groupKey, ws) AS isFinal
  FROM u WINDOW w AS (PARTITION BY ruleId, groupKey, ws ORDER BY event_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (
  SELECT ruleId, groupKey, {local_sql('ws')} AS windowStart, {local_sql('ws + width')} AS windowEnd,
         {local_sql('ts')} AS producedAt, cnt, round(total_raw, 4) AS total,
         CASE WHEN ruleId = 'R_USER_DAY' THEN COALESCE(cnt >= 2 AND total_raw > 20, false)
              ELSE COALESCE(cnt >= 4 OR total_raw > 1000, false) END AS thresholdBreached,
         isFinal, event_id * 4 + ridx * 2 AS seq, event_type, event_id, ridx,
         strftime(ts + to_microseconds(CAST(round(value * 10000) AS BIGINT)) + INTERVAL 330 MINUTE,
                  '%Y-%m-%d %H:%M:%S.%f') AS consumedAt
  FROM r),
messages AS (
  SELECT ruleId, groupKey, windowStart, windowEnd, producedAt, cnt, total, thresholdBreached, isFinal, seq, consumedAt
  FROM b
  UNION ALL
  SELECT ruleId, groupKey, windowStart, windowEnd, producedAt, cnt, total, thresholdBreached, false,
         (event_id + 500) * 4 + ridx * 2 + 1, consumedAt
  FROM b WHERE event_type = 'error'),
latest AS (
  SELECT * FROM messages
  QUALIFY row_number() OVER (PARTITION BY ruleId, groupKey, windowStart
                             ORDER BY isFinal DESC, producedAt DESC, seq DESC) = 1)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results table: the live rules' message stream over `events`,
    stored once under the shared checkpoint folder (a deployment's live
    job writes this table; analytics read it)."""
    from thresher.session import materialized
    from thresher.sources.results import standin_messages

    src = f"{sf_dir.rstrip('/')}/events.parquet"
    return materialized(spark, "result_messages", [src], lambda: standin_messages(events(spark, sf_dir)),
                        partition_by=["ruleId"], sort_within=["windowStart"])
