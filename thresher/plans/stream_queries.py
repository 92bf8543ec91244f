"""Streaming plans.  Each runs a Structured Streaming query over the events
file with `trigger(availableNow=True)` into a fresh folder under the shared
checkpoint folder, then returns a batch read of the output.

In append mode a window is emitted once the watermark (largest event time
seen, minus the allowed lateness) passes its end, so windows ending after
`max(ts) - lateness` are still open when the run ends; the oracle SQL
applies the same bound.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from thresher.plans.common import MESSAGES_CTE, cond, events, group, local_sql, messages, rule
from thresher.plans.registry import register, rounded
from thresher.session import arrive, files_for, scratch_path
from thresher.sources.results import aggregate, raw_result_json
from thresher.spec import RuleSpec
from thresher.operators.rulestore import lifecycle
from thresher.sources.rule_tables import change_log
from thresher.streaming.evaluate import (
    evaluate_rule_family, evaluate_stream, file_event_stream, route_to_sinks, run_available,
)
from thresher.streaming.rule_control import RuleStatusTable, admit
from thresher.streaming.live import STATE_COLS, ViewMerger, keyed_latest, message_stream

TUMBLING_RULE = rule(
    "R_STREAM", ["user_id"], 86400000, [("cnt", "event_id", "COUNT"), ("total", "value", "SUM")],
    "cnt >= 2 && total > 20",
    group("AND", cond("event_type", "IN", "purchase, click"), cond("value", "GREATER_THAN", 5)),
    sinks={"agg_sink_enabled": True, "anomaly_sink_enabled": True, "anomaly_store_sink_enabled": True},
)
TUMBLING_RULE["windowing"]["allowed_lateness_ms"] = 3600000

SLIDING_RULE = rule(
    "R_SLIDE", ["event_type"], 21600000,
    [("cnt", "event_id", "COUNT"), ("users", "user_id", "COUNT_DISTINCT"), ("mx", "value", "MAX")],
    "users >= 5 && mx > 400",
)
SLIDING_RULE["windowing"].update({"type": "SLIDING", "slide_ms": 7200000, "alignment_offset_ms": 1800000,
                                  "allowed_lateness_ms": 7200000})

HOURLY_RULE = rule("R_HOURLY", ["event_type"], 3600000, [("cnt", "event_id", "COUNT"), ("total", "value", "SUM")],
                   "cnt >= 4")
HOURLY_RULE["windowing"]["allowed_lateness_ms"] = 1800000


def _stream(spark, sf_dir):
    schema = events(spark, sf_dir).schema
    return file_event_stream(spark, sf_dir, schema, glob="events.parquet")


def _final(spark, sf_dir, doc, tag):
    out, ckpt = scratch_path(spark, f"{tag}-out"), scratch_path(spark, f"{tag}-ckpt")
    run_available(evaluate_stream(_stream(spark, sf_dir), doc), "append", ckpt, out)
    return spark.read.parquet(out)


_TUMBLING_SQL = f"""
WITH m AS (SELECT * FROM events WHERE event_type IN ('purchase', 'click') AND value > 5),
g AS (SELECT time_bucket(INTERVAL '86400 seconds', ts) AS ws, user_id, COUNT(event_id) AS cnt, SUM(value) AS total
      FROM m GROUP BY ws, user_id),
f AS (SELECT 'R_STREAM' AS ruleId, CAST(user_id AS VARCHAR) AS groupKey, {local_sql('ws')} AS windowStart,
             {local_sql("ws + INTERVAL 86400 SECOND")} AS windowEnd, cnt, round(total, 4) AS total,
             COALESCE(cnt >= 2 AND total > 20, false) AS thresholdBreached
      FROM g WHERE ws + INTERVAL 86400 SECOND <= (SELECT max(ts) FROM m) - INTERVAL 3600 SECOND)"""


@register("stream_tumbling_final", covers="ST12 ST14 S5", sql=f"""{_TUMBLING_SQL}
SELECT * FROM f""")
def stream_tumbling_final(spark, sf_dir):
    return rounded(_final(spark, sf_dir, TUMBLING_RULE, "tumbling"))


@register("stream_sliding_final", covers="ST12 ST14", sql=f"""
WITH e AS (SELECT *, epoch_us(ts) AS us FROM events),
w AS (SELECT e.*, ((us - 1800000000) // 7200000000) * 7200000000 + 1800000000 - k * 7200000000 AS ws_us
      FROM e, range(0, 3) r(k)),
g AS (SELECT make_timestamp(ws_us) AS ws, event_type, COUNT(event_id) AS cnt, COUNT(DISTINCT user_id) AS users,
             MAX(value) AS mx
      FROM w GROUP BY ws_us, event_type)
SELECT 'R_SLIDE' AS ruleId, event_type AS groupKey, {local_sql('ws')} AS windowStart,
       {local_sql("ws + INTERVAL 21600 SECOND")} AS windowEnd, cnt, users, round(mx, 4) AS mx,
       COALESCE(users >= 5 AND mx > 400, false) AS thresholdBreached
FROM g WHERE ws + INTERVAL 21600 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 7200 SECOND""")
def stream_sliding_final(spark, sf_dir):
    return rounded(_final(spark, sf_dir, SLIDING_RULE, "sliding"))


@register("stream_partial_then_final", covers="ST13 ST14", sql=f"""
WITH g AS (SELECT time_bucket(INTERVAL '3600 seconds', ts) AS ws, event_type, COUNT(event_id) AS cnt,
                  SUM(value) AS total FROM events GROUP BY ws, event_type),
r AS (SELECT 'R_HOURLY' AS ruleId, event_type AS groupKey, {local_sql('ws')} AS windowStart,
             {local_sql("ws + INTERVAL 3600 SECOND")} AS windowEnd, cnt, round(total, 4) AS total,
             COALESCE(cnt >= 4, false) AS thresholdBreached, ws FROM g)
SELECT ruleId, groupKey, windowStart, windowEnd, cnt, total, thresholdBreached, false AS isFinal FROM r
UNION ALL
SELECT ruleId, groupKey, windowStart, windowEnd, cnt, total, thresholdBreached, true FROM r
WHERE ws + INTERVAL 3600 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 1800 SECOND""")
def stream_partial_then_final(spark, sf_dir):
    partial_out, final_out = scratch_path(spark, "partial-out"), scratch_path(spark, "final-out")

    def keep(path):
        def write(batch, epoch):
            batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        return write

    run_available(evaluate_stream(_stream(spark, sf_dir), HOURLY_RULE), "update",
                  scratch_path(spark, "partial-ckpt"), keep(partial_out))
    run_available(evaluate_stream(_stream(spark, sf_dir), HOURLY_RULE), "append",
                  scratch_path(spark, "final-ckpt"), final_out)
    partial = spark.read.parquet(partial_out).drop("epoch").withColumn("isFinal", F.lit(False))
    final = spark.read.parquet(final_out).withColumn("isFinal", F.lit(True))
    return rounded(partial.unionByName(final))


@register("stream_sink_routing", covers="S11 ST16", sql=f"""{_TUMBLING_SQL}
SELECT 'agg' AS sink, ruleId, groupKey, windowStart, cnt, thresholdBreached FROM f
UNION ALL
SELECT 'anomaly', ruleId, groupKey, windowStart, cnt, thresholdBreached FROM f WHERE thresholdBreached
UNION ALL
SELECT 'store', ruleId, groupKey, windowStart, cnt, thresholdBreached FROM f WHERE thresholdBreached""")
def stream_sink_routing(spark, sf_dir):
    spec = RuleSpec.from_dict(TUMBLING_RULE)
    paths = {sink: scratch_path(spark, f"{sink}-sink") for sink in ("agg", "anomaly", "store")}
    run_available(evaluate_stream(_stream(spark, sf_dir), spec), "append", scratch_path(spark, "route-ckpt"),
                  lambda b, e: route_to_sinks(b, e, spec, *paths.values()))
    cols = ["ruleId", "groupKey", "windowStart", "cnt", "thresholdBreached"]
    sinks = [spark.read.parquet(path).select(F.lit(sink).alias("sink"), *cols) for sink, path in paths.items()]
    return sinks[0].unionByName(sinks[1]).unionByName(sinks[2])


@register("stream_live_state", covers="ST1 ST3 ST9 S5", sql=f"""
WITH {MESSAGES_CTE},
n AS (SELECT ruleId, groupKey, windowStart, windowEnd, cnt, total, thresholdBreached,
             CASE WHEN ruleId = 'R_TYPE_HOUR' THEN true ELSE isFinal END AS isFinal, seq FROM messages)
SELECT ruleId, groupKey, windowStart, windowEnd, cnt, total, thresholdBreached, isFinal, seq,
       MIN(seq) OVER (PARTITION BY ruleId, groupKey, windowStart) AS first_seq
FROM n
QUALIFY row_number() OVER (PARTITION BY ruleId, groupKey, windowStart ORDER BY isFinal DESC, seq DESC) = 1""")
def stream_live_state(spark, sf_dir):
    """Result messages land in four parts in arrival order; the stream takes
    one part per micro-batch and merges each batch's changed keys into the
    view.  The final view must equal the batch upsert of all messages."""
    inbox = scratch_path(spark, "messages")
    raw = raw_result_json(messages(spark, sf_dir))
    top, rows = raw.agg(F.max("seq"), F.count(F.lit(1))).first()
    step = top // 4 + 1
    files = max(4, files_for(-(-rows // 4)))
    for i in range(4):  # sequential writes: file times follow arrival order
        arrive(raw.where((F.col("seq") >= i * step) & (F.col("seq") < (i + 1) * step)), inbox, files, "json")
    merger = ViewMerger(scratch_path(spark, "view"))
    stream = message_stream(spark, inbox, max_files_per_trigger=files).select(*STATE_COLS)
    run_available(keyed_latest(stream), "update", scratch_path(spark, "view-ckpt"), merger)
    view = spark.read.parquet(merger.snapshot_path(merger.last_epoch))
    # cnt and total once more from the aggregates that the view carries, under whatever names
    again = {"cnt": aggregate(F.col("aggResult"), "cnt", "bigint"), "total": aggregate(F.col("aggResult"), "total", "double")}
    return rounded(view.select(*STATE_COLS, "first_seq").withColumns(again).drop("aggResult"))


FAMILY_RULE = rule("rule_family", ["__GLOBAL__"], 86400000,
                   [("cnt", "event_id", "COUNT"), ("total", "value", "SUM")], "cnt >= 2",
                   cond("event_type", "IN", "purchase, click"))
FAMILY_RULE["windowing"]["allowed_lateness_ms"] = 3600000


def _family_sql() -> str:
    from thresher.plans.rules_queries import RULES_CTE

    return f"""
WITH RECURSIVE {RULES_CTE},
act AS (SELECT rule_id FROM final WHERE status = 'ACTIVE'),
m AS (SELECT e.*, 'rule_' || CAST(e.user_id AS VARCHAR) AS rid FROM events e
      WHERE 'rule_' || CAST(e.user_id AS VARCHAR) IN (SELECT rule_id FROM act)
        AND e.event_type IN ('purchase', 'click')),
g AS (SELECT rid, time_bucket(INTERVAL '86400 seconds', ts) AS ws, COUNT(event_id) AS cnt, SUM(value) AS total
      FROM m GROUP BY rid, ws)
SELECT rid AS ruleId, '__GLOBAL__' AS groupKey, {local_sql('ws')} AS windowStart,
       {local_sql("ws + INTERVAL 86400 SECOND")} AS windowEnd, cnt, round(total, 4) AS total,
       COALESCE(cnt >= 2, false) AS thresholdBreached
FROM g WHERE ws + INTERVAL 86400 SECOND <= (SELECT max(ts) FROM m) - INTERVAL 3600 SECOND"""


@register("stream_rule_control", covers="ST15 ST12", sql=_family_sql())
def stream_rule_control(spark, sf_dir):
    """One rule per user (`rule_<user_id>`), one window shape: events pass
    only while their rule is ACTIVE in the rule-status table (re-read every
    micro-batch), and all rules share one streaming aggregation."""
    status = lifecycle(change_log(events(spark, sf_dir)))
    key = F.concat(F.lit("rule_"), F.col("user_id").cast("string"))
    out, ckpt = scratch_path(spark, "family-out"), scratch_path(spark, "family-ckpt")
    run_available(evaluate_rule_family(_stream(spark, sf_dir), FAMILY_RULE, key, status), "append", ckpt, out)
    return rounded(spark.read.parquet(out))


def _epochs_sql() -> str:
    from thresher.plans.rules_queries import RULES_CTE

    return f"""
WITH RECURSIVE {RULES_CTE},
step AS (SELECT max(event_id) // 4 + 1 AS width FROM events),
ends AS (SELECT rule_id, seq // width AS part, max(i) AS i
         FROM (SELECT rule_id, seq, row_number() OVER (PARTITION BY rule_id ORDER BY seq) AS i FROM cl), step GROUP BY ALL),
m AS (SELECT e.*, ends.rule_id AS rid FROM events e, step
      JOIN ends ON ends.rule_id = 'rule_' || CAST(e.user_id AS VARCHAR) AND ends.part = e.event_id // width
      JOIN st ON st.rule_id = ends.rule_id AND st.i = ends.i
      WHERE st.status = 'ACTIVE' AND e.event_type IN ('purchase', 'click')),
g AS (SELECT rid, time_bucket(INTERVAL '86400 seconds', ts) AS ws, COUNT(event_id) AS cnt, SUM(value) AS total FROM m GROUP BY rid, ws)
SELECT rid AS ruleId, '__GLOBAL__' AS groupKey, {local_sql('ws')} AS windowStart,
       {local_sql("ws + INTERVAL 86400 SECOND")} AS windowEnd, cnt, round(total, 4) AS total,
       COALESCE(cnt >= 2, false) AS thresholdBreached
FROM g WHERE ws + INTERVAL 86400 SECOND <= (SELECT max(ts) FROM m) - INTERVAL 3600 SECOND"""


@register("stream_rule_control_epochs", covers="ST15 R5 R7", sql=_epochs_sql())
def stream_rule_control_epochs(spark, sf_dir):
    """The events as a log that both changes rules and feeds them, in four
    micro-batches: each moves the status table on by its own actions, and its
    events pass if their rule is ACTIVE by then.  So a rule that is paused in
    one batch loses that batch's events and no earlier ones."""
    log, admitted = scratch_path(spark, "control-log"), scratch_path(spark, "admitted")
    ev = events(spark, sf_dir)
    width = ev.agg(F.max("event_id")).first()[0] // 4 + 1
    for i in range(4):  # one after the other: file times follow the log
        ev.where((F.col("event_id") >= i * width) & (F.col("event_id") < (i + 1) * width)).repartitionByRange(4, "event_id").write.mode("append").parquet(log)
    status = RuleStatusTable(spark, scratch_path(spark, "rule-status"), base_every=3)
    key = F.concat(F.lit("rule_"), F.col("user_id").cast("string"))
    source = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 4).parquet(log)
    run_available(source, "append", scratch_path(spark, "control-ckpt"), admit(status, change_log, key, admitted))
    passed = spark.readStream.schema(ev.schema.add("__rule_id", "string")).parquet(f"{admitted}/*")
    out = scratch_path(spark, "controlled-out")
    run_available(evaluate_stream(passed, FAMILY_RULE, rule_col="__rule_id"), "append", scratch_path(spark, "controlled-ckpt"), out)
    return rounded(spark.read.parquet(out))
