"""Filter-tree plans: every leaf operator, nesting, and lenient dropping."""

from __future__ import annotations

from pyspark.sql import functions as F

from thresher.functions.timeutil import resolve_range
from thresher.operators.backtest import rule_matches
from thresher.plans.common import MATCHED_SQL, cond, events, group, rule, table, whole_range
from thresher.plans.registry import register, rounded

OUT = ["event_id", "user_id", "event_type", "value"]


def _matches(spark, sf_dir, tree, ev=None, **kw):
    ev = events(spark, sf_dir) if ev is None else ev
    start, end = resolve_range(*whole_range(ev))
    doc = rule("F", ["user_id"], 86400000, [("n", "event_id", "COUNT")], "", tree)
    return rounded(rule_matches(ev, doc, start, end, **kw).select(*OUT))


def _sql(where: str, source: str = MATCHED_SQL) -> str:
    return f"SELECT event_id, user_id, event_type, round(value, 4) AS value FROM {source} m WHERE {where}"


COMPARISONS = group(
    "AND",
    cond("value", "GREATER_THAN_EQUAL", 10.5), cond("value", "LESS_THAN", 300),
    cond("user_id", "NOT_EQUALS", 7), cond("event_id", "LESS_THAN_EQUAL", "8000"),
    cond("user_id", "GREATER_THAN", 3.5),
)


@register("filter_comparisons", covers="F2-F7 V13",
          sql=_sql("value >= 10.5 AND value < 300 AND user_id != 7 AND event_id <= 8000 AND user_id > 3.5"))
def filter_comparisons(spark, sf_dir):
    return _matches(spark, sf_dir, COMPARISONS)


IN_LIST = group(
    "OR",
    cond("event_type", "IN", "purchase, click"), cond("user_id", "IN", [1, 2, 3, "4"]),
    cond("event_type", "IN", ""), cond("event_type", "IN", []),
)


@register("filter_in_list", covers="F8 F1",
          sql=_sql("event_type IN ('purchase', 'click') OR user_id IN (1, 2, 3, 4) OR event_type IN ('')"))
def filter_in_list(spark, sf_dir):
    return _matches(spark, sf_dir, IN_LIST)


TEXT_OPS = group(
    "AND",
    group("OR", cond("event_type", "STARTS_WITH", "p"), cond("event_type", "ENDS_WITH", "w")),
    cond("event_type", "NOT_CONTAINS", "ie"),
    cond("value", "CONTAINS", ".5"),
)


@register("filter_text_ops", covers="F10-F13", sql=_sql(
    "(starts_with(event_type, 'p') OR ends_with(event_type, 'w')) AND NOT contains(event_type, 'ie') "
    "AND contains(CAST(value AS VARCHAR), '.5')"))
def filter_text_ops(spark, sf_dir):
    return _matches(spark, sf_dir, TEXT_OPS)


NULL_OPS = group(
    "AND",
    group("OR",
          group("AND", cond("event_type", "IS_NULL"), cond("value", "GREATER_THAN", 200)),
          group("AND", cond("event_type", "NOT_EQUALS", "view"), cond("value", "GREATER_THAN", 450))),
    cond("_data.k", "IS_NOT_NULL"),
)

_NULLED = """(SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM
  (SELECT event_id, ts, user_id, NULLIF(event_type, 'error') AS event_type, value, props FROM events)
  QUALIFY row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '3600 seconds', ts)
                             ORDER BY event_id DESC NULLS LAST) = 1)"""


@register("filter_null_ops", covers="F14 F15 V14", sql=_sql(
    "((event_type IS NULL AND value > 200) OR (event_type != 'view' AND value > 450)) AND k IS NOT NULL", _NULLED))
def filter_null_ops(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("event_type", F.nullif(F.col("event_type"), F.lit("error")))
    return _matches(spark, sf_dir, NULL_OPS, ev)


REGEX = group(
    "AND",
    group("OR", cond("event_type", "REGEX", "^(pur|cl)"), cond("props", "REGEX", '"k": [1-3][0-9]}')),
    cond("value", "REGEX", "^1"),
)


@register("filter_regex", covers="F9 V17", sql=_sql(
    "(regexp_matches(event_type, '^(pur|cl)') OR regexp_matches(props, '\"k\": [1-3][0-9]}')) "
    "AND regexp_matches(CAST(value AS VARCHAR), '^1')"))
def filter_regex(spark, sf_dir):
    return _matches(spark, sf_dir, REGEX)


DATES = group(
    "AND",
    cond("ts", "DATE_AFTER", "2024-01-05T10:00:00+05:30", "ISO_STRING"),
    cond("ts", "DATE_BEFORE", "1705000000000", "EPOCH_MILLIS"),
    group("OR", cond("ts", "DATE_EQUALS", "2024-01-07T00:00:00Z"), cond("value", "GREATER_THAN", 100)),
)


@register("filter_dates", covers="F16 V19", sql=_sql(
    "ts > TIMESTAMP '2024-01-05 04:30:00' AND ts < TIMESTAMP '2024-01-11 19:06:40' "
    "AND (ts = TIMESTAMP '2024-01-07 00:00:00' OR value > 100)"))
def filter_dates(spark, sf_dir):
    return _matches(spark, sf_dir, DATES)


NESTED = group(
    "OR",
    group("XOR", cond("event_type", "EQUALS", "purchase"), cond("value", "GREATER_THAN", 100)),
    group("AND", group("OR", cond("user_id", "LESS_THAN", 10), cond("user_id", "GREATER_THAN_EQUAL", 140)),
          cond("event_type", "EQUALS", "signup")),
    group("AND"),
)


@register("filter_nested_tree", covers="F1", sql=_sql(
    "(event_type = 'purchase' AND value > 100) OR ((user_id < 10 OR user_id >= 140) AND event_type = 'signup')"))
def filter_nested_tree(spark, sf_dir):
    return _matches(spark, sf_dir, NESTED)


LENIENT = group(
    "AND",
    cond("value", "GREATER_THAN", 50),
    cond("1bad", "EQUALS", 3),
    cond("value", "BETWEEN", [1, 2]),
    cond("event_type", "IN", []),
    cond("ts", "DATE_AFTER", "2024-01-05", "WEIRD"),
    cond("ts", "DATE_BEFORE", "2024-01-05T10:00:00"),
)


@register("filter_lenient_drop", covers="V12 F19", sql=_sql("value > 50"))
def filter_lenient_drop(spark, sf_dir):
    return _matches(spark, sf_dir, LENIENT)


CODE_LIST = group("OR", {"type": "condition", "operator": "IS_FINANCIAL_AUA"}, cond("value", "GREATER_THAN", 450))


@register("filter_code_list_semi", covers="F17 J8", sql=_sql(
    "user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR value > 450"))
def filter_code_list_semi(spark, sf_dir):
    codes = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return _matches(spark, sf_dir, CODE_LIST, code_list=codes, code_field="user_id")
