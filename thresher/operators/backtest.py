"""Rule backtest: filter -> tumbling window -> group -> aggregates -> flag.

The plan Catalyst gets is

    scan (pushed range filter, pruned columns)
      -> dedup (WindowGroupLimit, partial before the shuffle)
      -> rule filter
      -> hash aggregate on (bucket, keys)  (partial + final, map-side combine)
      -> flag projection
      -> TakeOrderedAndProject (newest windows, only when a limit is asked for)

so one hot key is combined inside each map task and only one partial row
per task and window crosses the network.
"""

from __future__ import annotations

import datetime as dt
import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thresher.functions.predicates import (
    CODE_LIST_MARKER, FilterContext, attach_code_list, compile_filter, uses_code_list,
)
from thresher.functions.threshold import compile_threshold
from thresher.functions.timeutil import bucket_start, resolve_range, to_local_text
from thresher.sources.events import STANDIN_SOURCE, EventSource, matched_events
from thresher.spec import GLOBAL_KEY, RuleSpec, column_for

log = logging.getLogger(__name__)


@dataclass
class CompiledRule:
    spec: RuleSpec
    key_cols: list[str]
    aggs: list[Column]
    aliases: list[str]
    bucket_seconds: int
    filter_tree: dict | None


def agg_column(function: str, col: Column, approximate: bool = False) -> Column:
    """Aggregate function name (case-insensitive) -> Column.  Unknown names
    fall back to COUNT with a warning."""
    fn = (function or "").upper()
    if fn == "COUNT_DISTINCT":
        return F.approx_count_distinct(col) if approximate else F.count_distinct(col)
    if fn == "COUNT":
        return F.count(col)
    if fn == "SUM":
        return F.sum(col)
    if fn == "AVG":
        return F.avg(col)
    if fn == "MIN":
        return F.min(col)
    if fn == "MAX":
        return F.max(col)
    log.warning("unknown aggregation function %r, using COUNT", function)
    return F.count(col)


def compile_rule(rule: dict | RuleSpec, columns: list[str] | None = None) -> CompiledRule:
    spec = rule if isinstance(rule, RuleSpec) else RuleSpec.from_dict(rule)
    if not spec.keys:
        raise ValueError("rule has no grouping keys")
    if not spec.aggregations:
        raise ValueError("rule has no aggregations")
    lower = {c.lower(): c for c in (columns or [])}

    def real(name: str) -> str:
        if columns is None:
            return name
        if name not in lower:
            raise ValueError(f"unknown column {name!r}")
        return lower[name]

    key_cols = [] if spec.is_global else [real(column_for(k)) for k in spec.keys]
    aggs, aliases = [], []
    for a in spec.aggregations:
        field = real(column_for(a.field))
        alias = column_for(a.alias)
        aliases.append(alias)
        aggs.append(agg_column(a.function, F.col(field)).alias(alias))
    return CompiledRule(spec, key_cols, aggs, aliases, spec.window.backtest_seconds(), spec.filters)


def group_key_text(key_cols: list[str], schema=None) -> Column:
    """Group keys -> one text: each key as text, null -> 'N/A', joined by '|'.
    With a schema, doubles print in plain decimal (see `number_text`)."""
    from thresher.functions.timeutil import number_text

    if not key_cols:
        return F.lit(GLOBAL_KEY)
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    parts = [F.coalesce(number_text(F.col(k), types.get(k)), F.lit("N/A")) for k in key_cols]
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


def rule_matches(events: DataFrame, rule: dict | RuleSpec, start: dt.datetime, end: dt.datetime,
                 source: EventSource = STANDIN_SOURCE, strict: bool = False,
                 code_list: DataFrame | None = None, code_field: str = "user_id") -> DataFrame:
    """Deduplicated events in the closed range that pass the rule's filter."""
    spec = rule if isinstance(rule, RuleSpec) else RuleSpec.from_dict(rule)
    df = matched_events(events, source, start, end)
    if code_list is not None and uses_code_list(spec.filters):
        df = attach_code_list(df, code_list, code_field)
    ctx = FilterContext(df.schema, strict=strict,
                        code_marker=CODE_LIST_MARKER if CODE_LIST_MARKER in df.columns else None)
    pred = compile_filter(spec.filters, ctx)
    return df if pred is None else df.where(pred)


def windowed_aggregates(matched: DataFrame, compiled: CompiledRule, time_col: str = "ts") -> DataFrame:
    """One row per (window, group): window start (UTC), raw keys, aggregates."""
    bucket = bucket_start(F.col(time_col), compiled.bucket_seconds).alias("__window_start")
    grouped = matched.groupBy(bucket, *[F.col(k) for k in compiled.key_cols])
    return grouped.agg(*compiled.aggs)


def backtest(events: DataFrame, rule: dict | RuleSpec, start_ts: str | None = None,
             end_ts: str | None = None, now: dt.datetime | None = None,
             source: EventSource = STANDIN_SOURCE, limit: int | None = None,
             strict: bool = False, code_list: DataFrame | None = None,
             code_field: str = "user_id", local_text: bool = True) -> DataFrame:
    """Run a rule over the event table for a local-time range.

    Output: window_start, groupKey, one column per aggregate alias (lower
    case), threshold_met; all rows, or with a `limit` the newest windows
    (ties broken by groupKey).  Windows are always tumbling here.
    """
    start, end = resolve_range(start_ts, end_ts, now)
    matched = rule_matches(events, rule, start, end, source, strict, code_list, code_field)
    compiled = compile_rule(rule, matched.columns)
    per_window = windowed_aggregates(matched, compiled, source.time_col)
    flag = compile_threshold(compiled.spec.threshold, compiled.aliases)
    if flag.error:
        log.warning("rule %s: threshold ignored: %s", compiled.spec.rule_id, flag.error)
    ws = F.col("__window_start")
    out = per_window.select(
        ws,
        group_key_text(compiled.key_cols, per_window.schema).alias("groupKey"),
        *[F.col(a) for a in compiled.aliases],
        flag.column.alias("threshold_met"),
    )
    if limit is not None:
        out = out.orderBy(ws.desc(), F.col("groupKey").asc()).limit(limit)
    win = to_local_text(ws) if local_text else ws
    return out.select(win.alias("window_start"), "groupKey", *compiled.aliases, "threshold_met")
