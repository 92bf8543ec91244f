"""Live-state plans over the result message stream (derived from events)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from thresher.functions.timeutil import ntz_text, parse_window_start_col
from thresher.operators.livestate import (
    apply_batch, cap_per_rule, delta_batches, prune_leading, recent_anomalies, snapshot, stats, upsert,
)
from thresher.operators.metrics import DEFAULT_BUCKETS, delay_histogram
from thresher.plans.common import MESSAGES_CTE, messages
from thresher.plans.registry import register, rounded
from thresher.session import scratch_path
from thresher.sources.results import (
    aggregate, anomaly_events, normalise_anomalies, normalise_results, raw_anomaly_json, raw_result_json,
)

STATE_COLS = ["ruleId", "groupKey", "windowStart", "cnt", "total", "thresholdBreached", "isFinal",
              "first_seq", "last_seq"]
_STATE_SEL = ", ".join(STATE_COLS)
_UPSERTED = """upserted AS (
  SELECT *, MIN(seq) OVER k AS first_seq, MAX(seq) OVER k AS last_seq FROM messages
  WINDOW k AS (PARTITION BY ruleId, groupKey, windowStart)
  QUALIFY row_number() OVER (PARTITION BY ruleId, groupKey, windowStart ORDER BY isFinal DESC, seq DESC) = 1)"""
CAP = 2000
# Cutoff of the prune plan: windows that started at or before this local
# time are stale.
PRUNE_CUTOFF_UTC = dt.datetime(2024, 1, 14, 18, 30)
FLUSH_SEQ = 800  # a flush holds the messages of 200 consecutive events


@register("live_upsert_final_wins", covers="ST3 C7 C8 D6", sql=f"""
WITH {MESSAGES_CTE}, {_UPSERTED}
SELECT {_STATE_SEL} FROM upserted""")
def live_upsert_final_wins(spark, sf_dir):
    return upsert(messages(spark, sf_dir)).select(*STATE_COLS)


@register("live_cap_per_rule", covers="W2 ST4", sql=f"""
WITH {MESSAGES_CTE}, {_UPSERTED}
SELECT {_STATE_SEL} FROM upserted
QUALIFY row_number() OVER (PARTITION BY ruleId ORDER BY first_seq DESC) <= {CAP}""")
def live_cap_per_rule(spark, sf_dir):
    return cap_per_rule(upsert(messages(spark, sf_dir)), CAP).select(*STATE_COLS)


@register("live_prune_leading", covers="W3 ST5", sql=f"""
WITH {MESSAGES_CTE}, {_UPSERTED},
capped AS (SELECT * FROM upserted QUALIFY row_number() OVER (PARTITION BY ruleId ORDER BY first_seq DESC) <= 25000),
stops AS (
  SELECT ruleId AS rule, MIN(first_seq) AS stop FROM capped
  WHERE strptime(windowStart, '%Y-%m-%d %H:%M:%S') - INTERVAL 330 MINUTE > TIMESTAMP '2024-01-14 18:30:00'
     OR try_strptime(windowStart, '%Y-%m-%d %H:%M:%S') IS NULL
  GROUP BY ruleId)
SELECT {_STATE_SEL} FROM capped JOIN stops ON capped.ruleId = stops.rule WHERE first_seq >= stop""")
def live_prune_leading(spark, sf_dir):
    return apply_batch(messages(spark, sf_dir), cutoff=PRUNE_CUTOFF_UTC).select(*STATE_COLS)


@register("live_snapshot", covers="ST7 ST8", sql=f"""
WITH {MESSAGES_CTE}, {_UPSERTED}
SELECT ruleId, groupKey, windowStart, cnt, first_seq FROM upserted
WHERE ruleId IN ('R_TYPE_HOUR', 'R_MISSING') AND ruleId != 'R_USER_DAY'
ORDER BY ruleId, first_seq""")
def live_snapshot(spark, sf_dir):
    from thresher.operators.livestate import drop_rule

    state = drop_rule(upsert(messages(spark, sf_dir)), "R_USER_DAY")
    return snapshot(state, ["R_TYPE_HOUR", "R_MISSING"]).select("ruleId", "groupKey", "windowStart", "cnt",
                                                                 "first_seq")


@register("live_stats", covers="A19", sql=f"""
WITH {MESSAGES_CTE}, {_UPSERTED},
kept AS (SELECT * FROM upserted QUALIFY row_number() OVER (PARTITION BY ruleId ORDER BY first_seq DESC) <= {CAP})
SELECT (SELECT COUNT(*) FROM kept) AS total_rows, (SELECT COUNT(DISTINCT ruleId) FROM kept) AS rules,
       (SELECT COUNT(*) FROM upserted) - (SELECT COUNT(*) FROM kept) AS dropped_rows""")
def live_stats(spark, sf_dir):
    # counted three times over, so upserted once
    upsert(messages(spark, sf_dir)).select("ruleId", "first_seq").write.parquet(stored := scratch_path(spark, "upserted"))
    up = spark.read.parquet(stored)
    return stats(up, cap_per_rule(up, CAP))


@register("live_delta_batch", covers="ST9", sql=f"""
WITH {MESSAGES_CTE},
f AS (SELECT *, CAST(floor(seq / {FLUSH_SEQ}) AS BIGINT) AS flush FROM messages),
per_key AS (
  SELECT *, MIN(seq) OVER k AS first_seq FROM f
  WINDOW k AS (PARTITION BY flush, ruleId, groupKey, windowStart)
  QUALIFY row_number() OVER (PARTITION BY flush, ruleId, groupKey, windowStart ORDER BY isFinal DESC, seq DESC) = 1)
SELECT flush, ruleId, groupKey, windowStart, cnt, isFinal, first_seq FROM per_key""")
def live_delta_batch(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("flush", F.floor(F.col("seq") / FLUSH_SEQ).cast("long"))
    return delta_batches(m, "flush").select("flush", "ruleId", "groupKey", "windowStart", "cnt", "isFinal",
                                            "first_seq")


@register("live_recent_anomalies", covers="U1 ST16 D7 C17", sql=f"""
WITH {MESSAGES_CTE},
a AS (SELECT * FROM messages WHERE thresholdBreached AND isFinal),
buf AS (SELECT * FROM a WHERE ruleId IN ('R_USER_DAY', 'R_TYPE_HOUR')
        QUALIFY row_number() OVER (PARTITION BY ruleId ORDER BY seq DESC) <= 100)
SELECT ruleId AS request_rule, CASE ruleId WHEN 'R_USER_DAY' THEN 1 ELSE 2 END AS request_place,
       CAST(row_number() OVER (PARTITION BY ruleId ORDER BY seq) AS INTEGER) AS position,
       ruleId, groupKey, windowStart, cnt, seq FROM buf""")
def live_recent_anomalies(spark, sf_dir):
    from thresher.spec import split_id_list

    anoms = anomaly_events(messages(spark, sf_dir))
    out = recent_anomalies(anoms, split_id_list(" R_USER_DAY, R_TYPE_HOUR ,, "), 100)
    return out.select("request_rule", "request_place", "position", "ruleId", "groupKey", "windowStart", "cnt", "seq")


@register("normalise_results", covers="ST1 C16 C7 S9 C15", sql=f"""
WITH {MESSAGES_CTE}
SELECT ruleId, ruleId AS routeId, groupKey, windowStart, producedAt, cnt, total, thresholdBreached,
       CASE WHEN ruleId = 'R_TYPE_HOUR' THEN true ELSE isFinal END AS isFinal, 'agg' AS event_type, seq
FROM messages""")
def normalise_results_plan(spark, sf_dir):
    raw = raw_result_json(messages(spark, sf_dir))
    return rounded(normalise_results(raw).select("ruleId", "routeId", "groupKey", "windowStart", "producedAt",
                                                 "cnt", "total", "thresholdBreached", "isFinal", "event_type",
                                                 "seq"))


_SHAPE = "(seq // 4) % 4"


@register("normalise_any_shape", covers="ST1 S9 C6 C8 C15", sql=f"""
WITH {MESSAGES_CTE},
m AS (SELECT *, {_SHAPE} AS shape, strptime(windowStart, '%Y-%m-%d %H:%M:%S') - INTERVAL 330 MINUTE AS utc FROM messages)
SELECT seq, ruleId, groupKey, CASE WHEN shape = 0 THEN CAST(epoch_ms(utc) AS VARCHAR) ELSE windowStart END AS windowStart,
       strftime(utc, '%Y-%m-%d %H:%M:%S') AS started, CASE WHEN shape = 0 THEN cnt END AS hits, CASE WHEN shape = 0 THEN round(total, 4) END AS peak,
       CASE WHEN shape = 1 THEN cnt END AS n, CASE WHEN shape = 2 THEN 'n/a' END AS unread
FROM m""")
def normalise_any_shape(spark, sf_dir):
    """Messages of four shapes: aggregates of other names sent as an object
    with a numeric window start, other names sent as text, text that isn't
    JSON, and none at all."""
    m = messages(spark, sf_dir)
    shape = F.floor(F.col("seq") / 4) % 4
    millis = F.unix_millis(F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), parse_window_start_col(F.col("windowStart")))))
    head = [F.col("ruleId"), F.col("groupKey")]
    text = F.col("windowStart")
    raw = m.select("seq", F.when(shape == 0, F.to_json(F.struct(*head, millis.alias("windowStart"), F.struct(F.col("cnt").alias("hits"), F.col("total").alias("peak")).alias("aggResult"))))
                   .when(shape == 1, F.to_json(F.struct(*head, text, F.to_json(F.struct(F.col("cnt").alias("n"))).alias("aggResult"))))
                   .when(shape == 2, F.to_json(F.struct(*head, text, F.lit("n/a").alias("aggResult"))))
                   .otherwise(F.to_json(F.struct(*head, text))).alias("value"))
    rows = normalise_results(raw)
    agg = F.col("aggResult")
    return rounded(rows.select(
        "seq", "ruleId", "groupKey", "windowStart", ntz_text(parse_window_start_col(F.col("windowStart"))).alias("started"),
        aggregate(agg, "hits", "bigint").alias("hits"), aggregate(agg, "peak", "double").alias("peak"), aggregate(agg, "n", "bigint").alias("n"),
        F.when(F.try_parse_json(agg).isNull(), agg).alias("unread")))


@register("normalise_anomalies", covers="ST2 C16 D5", sql=f"""
WITH {MESSAGES_CTE}
SELECT ruleId, ruleId AS routeId, groupKey, windowStart, cnt, producedAt, 'anomaly' AS event_type, seq
FROM messages WHERE thresholdBreached AND isFinal""")
def normalise_anomalies_plan(spark, sf_dir):
    raw = raw_anomaly_json(anomaly_events(messages(spark, sf_dir)))
    return normalise_anomalies(raw).select("ruleId", "routeId", "groupKey", "windowStart", aggregate(F.col("body"), "cnt", "bigint").alias("cnt"),
                                           "producedAt", "event_type", "seq")


_BUCKETS_SQL = ", ".join(f"({b}, '{b}')" for b in DEFAULT_BUCKETS)


@register("consume_delay_histogram", covers="A22 C14 ST11", sql=f"""
WITH {MESSAGES_CTE},
t AS (SELECT 'results' AS topic, producedAt, consumedAt FROM messages
      UNION ALL SELECT 'anomalies', producedAt, consumedAt FROM messages WHERE thresholdBreached AND isFinal),
dl AS (SELECT topic, greatest(0.0, epoch_us(strptime(consumedAt, '%Y-%m-%d %H:%M:%S.%f'))
                              - epoch_us(strptime(producedAt, '%Y-%m-%d %H:%M:%S'))) / 1e6 AS delay FROM t
       WHERE try_strptime(producedAt, '%Y-%m-%d %H:%M:%S') IS NOT NULL),
bk AS (SELECT * FROM (VALUES {_BUCKETS_SQL}, ('inf'::DOUBLE, '+Inf')) v(le, le_text))
SELECT topic, le_text AS le, COUNT(*) FILTER (WHERE delay <= bk.le) AS count
FROM dl, bk GROUP BY topic, le_text""")
def consume_delay_histogram(spark, sf_dir):
    m = messages(spark, sf_dir)
    both = m.select(F.lit("results").alias("topic"), "producedAt", "consumedAt").unionByName(
        anomaly_events(m).select(F.lit("anomalies").alias("topic"), "producedAt", "consumedAt"))
    return delay_histogram(both, "topic", "producedAt", "consumedAt")
