"""Rule results: the message stream a live evaluator emits, and the table it
is stored in.

A result row is one (rule, group, window) with its aggregates, breach flag,
and whether it is the window's final emission.  The evaluator fires early:
each event that lands in a window produces a partial row with the running
aggregates, and the window's last event produces the final row.

`result_messages` derives exactly that stream from an event table with the
rule compiler (so the results tables grow with the events), with one extra
twist of real streams: early-fire rows of error events are re-delivered
late, after the final row of their window, to exercise "final never
regresses".  `seq` is the arrival order.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher.functions.threshold import compile_threshold
from thresher.functions.timeutil import bucket_start, to_local_text
from thresher.operators.backtest import compile_rule, group_key_text
from thresher.operators.running import running_sums
from thresher.session import scratch_path
from thresher.sources.events import STANDIN_SOURCE, EventSource, matched_events

# Fixed values (stand-in): how far behind a re-delivered early-fire row
# arrives, in events.
LATE_SHIFT = 500

RESULT_COLUMNS = ["ruleId", "groupKey", "windowStart", "windowEnd", "producedAt", "cnt", "total",
                  "aggResult", "thresholdBreached", "isFinal", "seq", "consumedAt"]
# Stand-in delivery lag of a message: value / 100 seconds after its event.
CONSUMED_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@dataclass(frozen=True)
class LiveRule:
    """A rule as the live evaluator runs it: a count and a sum per window."""

    doc: dict
    count_field: str = "event_id"
    sum_field: str = "value"


def result_messages(events: DataFrame, rules: list[LiveRule], start: dt.datetime, end: dt.datetime,
                    source: EventSource = STANDIN_SOURCE, late_type: str | None = "error",
                    chunk_width: int | None = None) -> DataFrame:
    """The evaluator's output stream for `rules` over the events in range.

    One scan and one dedup serve every rule: each event is tagged with the
    rules whose filter it passes (an array of structs, exploded), so a
    multi-rule run costs one pass, not one per rule.  Re-deliveries come
    out of the same explode.
    """
    from thresher.functions.predicates import FilterContext, compile_filter

    matched = matched_events(events, source, start, end)
    tags, thresholds = [], []
    for i, r in enumerate(rules):
        compiled = compile_rule(r.doc, matched.columns)
        pred = compile_filter(compiled.spec.filters, FilterContext(matched.schema))
        size = compiled.bucket_seconds
        ws = bucket_start(F.col(source.time_col), size)
        tag = F.struct(F.lit(compiled.spec.rule_id).alias("ruleId"), F.lit(i).alias("ridx"),
                       group_key_text(compiled.key_cols, matched.schema).alias("groupKey"), ws.alias("ws"),
                       (ws + F.make_dt_interval(secs=F.lit(size))).alias("we"),
                       F.col(r.count_field).isNotNull().cast("long").alias("one"),
                       F.col(r.sum_field).cast("double").alias("val"))
        tags.append(tag if pred is None else F.when(pred, tag))
        thresholds.append((compiled.spec.rule_id, compiled.spec.threshold))
    tagged = matched.select(
        F.col(source.order_col).alias("__order"), F.col(source.time_col).alias("__ts"),
        F.col("event_type").alias("__etype"),
        F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("__r"))
    # the running sums read the rows twice, so events are deduplicated and tagged once
    spark = events.sparkSession
    tagged.select("__order", "__ts", "__etype", "__r.*").write.parquet(stored := scratch_path(spark, "tagged-events"))
    rows = spark.read.parquet(stored)
    kw = {"chunk_width": chunk_width} if chunk_width else {}
    run = running_sums(rows, ["ruleId", "groupKey", "ws"], "__order",
                       {"cnt": F.col("one"), "total": F.col("val")}, last_flag="isFinal", **kw)
    flag: Column = F.lit(False)
    for rule_id, expr in thresholds:
        th = compile_threshold(expr, ["cnt", "total"]).column
        flag = F.when(F.col("ruleId") == rule_id, th).otherwise(flag)
    n = len(rules)
    seq = F.col("__order") * F.lit(2 * n) + F.col("ridx") * 2
    late_seq = (F.col("__order") + F.lit(LATE_SHIFT)) * F.lit(2 * n) + F.col("ridx") * 2 + 1
    copies = [F.struct(F.col("isFinal").alias("final"), seq.alias("seq"))]
    if late_type is not None:
        copies.append(F.when(F.col("__etype") == late_type, F.struct(F.lit(False).alias("final"), late_seq.alias("seq"))))
    out = run.select(
        "ruleId", "groupKey",
        to_local_text(F.col("ws")).alias("windowStart"),
        to_local_text(F.col("we")).alias("windowEnd"),
        to_local_text(F.col("__ts")).alias("producedAt"),
        "cnt", F.round("total", 4).alias("total"),
        flag.alias("thresholdBreached"),
        to_local_text(F.col("__ts") + F.make_dt_interval(
            secs=(F.round(F.col("val") * 10000) / 1000000).cast("decimal(18,6)")), CONSUMED_FORMAT
        ).alias("consumedAt"),
        F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())).alias("__c"),
    )
    agg = F.to_json(F.struct("cnt", "total"))
    return out.select("ruleId", "groupKey", "windowStart", "windowEnd", "producedAt", "cnt", "total",
                      agg.alias("aggResult"), "thresholdBreached", F.col("__c.final").alias("isFinal"),
                      F.col("__c.seq").alias("seq"), "consumedAt")


# Fixed values (stand-in): the two live rules of the test tables.
STANDIN_LIVE_RULES = [
    LiveRule({
        "rule_metadata": {"rule_id": "R_USER_DAY"},
        "filters": {"type": "group", "logic": "AND", "conditions": [
            {"type": "condition", "field": "event_type", "operator": "IN", "value": "purchase, click"},
            {"type": "condition", "field": "value", "operator": "GREATER_THAN", "value": 5}]},
        "grouping": {"keys": ["user_id"]},
        "windowing": {"type": "TUMBLING", "size_ms": 86400000},
        "aggregations": [{"alias": "cnt", "field": "event_id", "function": "COUNT"},
                         {"alias": "total", "field": "value", "function": "SUM"}],
        "having_thresholds": {"expression": "cnt >= 2 && total > 20"},
    }),
    LiveRule({
        "rule_metadata": {"rule_id": "R_TYPE_HOUR"},
        "grouping": {"keys": ["event_type"]},
        "windowing": {"type": "TUMBLING", "size_ms": 3600000},
        "aggregations": [{"alias": "cnt", "field": "event_id", "function": "COUNT"},
                         {"alias": "total", "field": "value", "function": "SUM"}],
        "having_thresholds": {"expression": "cnt >= 4 || total > 1000"},
    }),
]


def standin_messages(events: DataFrame) -> DataFrame:
    """Result messages of the stand-in live rules over all events."""
    start, end = dt.datetime(1900, 1, 1), dt.datetime(2999, 1, 1)
    return result_messages(events, STANDIN_LIVE_RULES, start, end)


def anomaly_events(messages: DataFrame) -> DataFrame:
    """Breaching final windows, as the anomaly stream carries them."""
    return messages.where(F.col("thresholdBreached") & F.col("isFinal")).select(
        F.col("ruleId").alias("id"), "ruleId", "groupKey", "windowStart", "producedAt", "cnt", "total",
        F.lit("anomaly").alias("event_type"), "seq", "consumedAt")


# ---------------------------------------------------------------- raw JSON ---

def raw_result_json(messages: DataFrame) -> DataFrame:
    """Messages as the JSON text producers send, in several schema
    generations: hourly-rule rows use the legacy names (`id`,
    `entityValue`, `aggregationResults`, flag as 0/1, no `isFinal`); the
    others use the current names.  Columns: value (text), seq."""
    legacy = F.col("ruleId") == "R_TYPE_HOUR"
    current = F.to_json(F.struct(
        F.col("ruleId"), F.col("groupKey"), F.col("windowStart"), F.col("windowEnd"), F.col("producedAt"),
        F.col("aggResult"), F.col("thresholdBreached"), F.col("isFinal")))
    old = F.to_json(F.struct(
        F.col("ruleId").alias("id"), F.col("groupKey").alias("entityValue"), F.col("windowStart"),
        F.col("windowEnd"), F.col("producedAt"), F.col("aggResult").alias("aggregationResults"),
        F.col("thresholdBreached").cast("int").alias("thresholdBreached")))
    return messages.select(F.when(legacy, old).otherwise(current).alias("value"), "seq")


_NUMERIC_TYPES = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _field(v: Column, key: str) -> Column:
    """The JSON value at `key` as a VARIANT: SQL null when the key is
    absent, a VOID variant when it holds JSON null."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def _text(v: Column, key: str) -> Column:
    """A field that must be JSON text; any other JSON type reads as null."""
    x = _field(v, key)
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def coerce_final(v: Column) -> Column:
    """isFinal of a parsed message: a JSON boolean as is, a number != 0;
    a missing key, JSON null, text or any other value counts as final."""
    x = _field(v, "isFinal")
    t = F.schema_of_variant(x)
    return (F.when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
            .when(t.rlike(_NUMERIC_TYPES), F.try_variant_get(x, "$", "double") != 0)
            .otherwise(F.lit(True)))


def coerce_breached(v: Column) -> Column:
    """thresholdBreached: a JSON boolean as is, a number counts when it is
    exactly 1 (how readers test it); missing, null or text is false."""
    x = _field(v, "thresholdBreached")
    t = F.schema_of_variant(x)
    return (F.when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
            .when(t.rlike(_NUMERIC_TYPES), F.try_variant_get(x, "$", "double") == 1)
            .otherwise(F.lit(False)))


def _scalar_text(v: Column, key: str) -> Column:
    """A field that is JSON text or a number, as text; else null."""
    x = _field(v, key)
    kind = F.schema_of_variant(x)
    return F.when(kind == "STRING", F.try_variant_get(x, "$", "string")).when(kind.rlike(_NUMERIC_TYPES), F.to_json(x))


def _time_text(v: Column, key: str) -> Column:
    """A time field: JSON text as it is; any JSON number is epoch milliseconds,
    written in whole digits whatever its notation (`1.7051904e12`)."""
    x = _field(v, key)
    whole = F.try_variant_get(x, "$", "double")
    return F.when(F.schema_of_variant(x).rlike(_NUMERIC_TYPES), F.when(F.abs(whole) < 1e16, whole.cast("long").cast("string"))).otherwise(_scalar_text(v, key))


def _aggregates_text(v: Column) -> Column:
    """A message's aggregates as text, whatever their names: the JSON of an
    object (`aggResult`, else the legacy `aggregationResults`, sent as an object
    or as text), or text that isn't JSON as it came."""
    def of(key: str) -> Column:
        x = _field(v, key)
        kind = F.schema_of_variant(x)
        return F.when(kind == "STRING", F.try_variant_get(x, "$", "string")).when(kind.isNotNull() & (kind != "VOID"), F.to_json(x))

    return F.coalesce(of("aggResult"), of("aggregationResults"))


def aggregate(agg_text: Column, name: str, kind: str) -> Column:
    """One aggregate of a row's `aggResult` text, by its alias; null when it is
    absent, of another type, or the text isn't JSON."""
    return F.try_variant_get(F.try_parse_json(agg_text), f"$.{name}", kind)


def _route(rule_id: Column, v: Column) -> Column:
    return F.coalesce(F.nullif(rule_id, F.lit("")), F.nullif(_text(v, "id"), F.lit("")), F.lit("unknown"))


def normalise_results(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Raw result JSON -> one normalised row per parseable message.

    Messages are parsed once into a VARIANT.  `ruleId` falls back to a
    non-empty text `id` only when the `ruleId` key is absent (presence, not
    non-null); `groupKey` falls back to a non-empty `entityValue` the same
    way; flags are coerced by `coerce_breached` / `coerce_final`.  `aggResult`
    keeps all aggregates (see `aggregate`; cnt and total are read from it
    here).  A numeric window start or end (epoch milliseconds) is kept as its
    digits, so each window has its own key.  The routing id is `ruleId`, else
    `id`, else 'unknown'.  Text that is not a JSON object is dropped.
    """
    rest = [c for c in raw.columns if c != value_col]
    parsed = raw.select(*rest, F.try_parse_json(F.col(value_col)).alias("__v"))
    v = F.col("__v")
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    rule_id = F.when(_field(v, "ruleId").isNotNull(), _text(v, "ruleId")) \
        .otherwise(F.nullif(_text(v, "id"), F.lit("")))
    group_key = F.when(_field(v, "groupKey").isNotNull(), _text(v, "groupKey")) \
        .otherwise(F.nullif(_text(v, "entityValue"), F.lit("")))
    agg_text = _aggregates_text(v)
    return parsed.where(is_object).select(
        *rest,
        rule_id.alias("ruleId"), _route(rule_id, v).alias("routeId"), group_key.alias("groupKey"),
        _time_text(v, "windowStart").alias("windowStart"), _scalar_text(v, "windowEnd").alias("windowEnd"),
        _scalar_text(v, "producedAt").alias("producedAt"), agg_text.alias("aggResult"),
        aggregate(agg_text, "cnt", "bigint").alias("cnt"), aggregate(agg_text, "total", "double").alias("total"),
        coerce_breached(v).alias("thresholdBreached"), coerce_final(v).alias("isFinal"),
        F.lit("agg").alias("event_type"),
    )


def raw_anomaly_json(anomalies: DataFrame) -> DataFrame:
    """Anomalies as producers send them: hourly-rule rows carry only the
    legacy `id`, the others both `id` and `ruleId`."""
    legacy = F.col("ruleId") == "R_TYPE_HOUR"
    cur = F.to_json(F.struct("id", "ruleId", "groupKey", "windowStart", "producedAt", "cnt", "total"))
    old = F.to_json(F.struct("id", "groupKey", "windowStart", "producedAt", "cnt", "total"))
    return anomalies.select(F.when(legacy, old).otherwise(cur).alias("value"), "seq")


def normalise_anomalies(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Raw anomaly JSON -> event_type 'anomaly', `ruleId` from a non-empty
    `id` when the `ruleId` key is absent, routing id with 'unknown' fallback;
    `body` keeps the whole message as JSON text."""
    rest = [c for c in raw.columns if c != value_col]
    parsed = raw.select(*rest, F.try_parse_json(F.col(value_col)).alias("__v"))
    v = F.col("__v")
    rule_id = F.when(_field(v, "ruleId").isNotNull(), _text(v, "ruleId")) \
        .otherwise(F.nullif(_text(v, "id"), F.lit("")))
    return parsed.where(F.schema_of_variant(v).startswith("OBJECT")).select(
        *rest, rule_id.alias("ruleId"), _route(rule_id, v).alias("routeId"),
        _scalar_text(v, "groupKey").alias("groupKey"), _time_text(v, "windowStart").alias("windowStart"),
        _scalar_text(v, "producedAt").alias("producedAt"), F.lit("anomaly").alias("event_type"), F.to_json(v).alias("body"))
