"""Filter trees: leaf operators, grouping, lenient dropping, strict mode."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from thresher.functions.predicates import (
    FilterContext, FilterError, UnknownColumnError, compile_filter, filter_frame, resolve_date_value,
)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, "purchase", 12.5, "a1", dt.datetime(2024, 1, 5, 10, 0)),
            (2, "click", 3.0, None, dt.datetime(2024, 1, 6, 0, 0)),
            (3, "view", 450.25, "b2", None),
            (4, None, 7.0, "a3", dt.datetime(2024, 1, 7, 12, 30))]
    return spark.createDataFrame(rows, "id long, event_type string, value double, code string, ts timestamp_ntz")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def leaf(field, op, value=None, fmt=None):
    n = {"type": "condition", "field": field, "operator": op}
    if value is not None:
        n["value"] = value
    if fmt:
        n["format"] = fmt
    return n


def test_comparisons_and_cast(frame):
    assert ids(filter_frame(frame, leaf("value", "GREATER_THAN", "7"))) == [1, 3]
    assert ids(filter_frame(frame, leaf("id", "LESS_THAN_EQUAL", 2.5))) == [1, 2]
    assert ids(filter_frame(frame, leaf("value", "EQUALS", "abc"))) == []  # bad text -> no match


def test_not_equals_skips_null(frame):
    assert ids(filter_frame(frame, leaf("event_type", "NOT_EQUALS", "view"))) == [1, 2]


def test_in_text_and_list(frame):
    assert ids(filter_frame(frame, leaf("event_type", "IN", "purchase , view"))) == [1, 3]
    assert ids(filter_frame(frame, leaf("id", "IN", [1, "4"]))) == [1, 4]


def test_empty_in_list_dropped(frame):
    assert ids(filter_frame(frame, leaf("id", "IN", []))) == [1, 2, 3, 4]


def test_text_ops(frame):
    assert ids(filter_frame(frame, leaf("code", "STARTS_WITH", "a"))) == [1, 4]
    assert ids(filter_frame(frame, leaf("code", "ENDS_WITH", "2"))) == [3]
    assert ids(filter_frame(frame, leaf("value", "CONTAINS", ".2"))) == [3]
    assert ids(filter_frame(frame, leaf("code", "NOT_CONTAINS", "a"))) == [3]


def test_regex_partial(frame):
    assert ids(filter_frame(frame, leaf("event_type", "REGEX", "ic"))) == [2]


def test_null_ops(frame):
    assert ids(filter_frame(frame, leaf("code", "IS_NULL"))) == [2]
    assert ids(filter_frame(frame, leaf("ts", "IS_NOT_NULL"))) == [1, 2, 4]


def test_dates(frame):
    # 2024-01-06T05:30+05:30 is 2024-01-06 00:00 UTC
    assert ids(filter_frame(frame, leaf("ts", "DATE_EQUALS", "2024-01-06T05:30:00+05:30", "ISO_STRING"))) == [2]
    ms = int((dt.datetime(2024, 1, 6) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    assert ids(filter_frame(frame, leaf("ts", "DATE_AFTER", str(ms), "EPOCH_MILLIS"))) == [4]


def test_date_without_offset_dropped():
    with pytest.raises(ValueError):
        resolve_date_value("2024-01-06T00:00:00", "ISO_STRING")


def test_groups(frame):
    tree = {"type": "group", "logic": "OR", "conditions": [
        leaf("id", "EQUALS", 1),
        {"type": "group", "logic": "weird", "conditions": [leaf("value", "GREATER_THAN", 5),
                                                            leaf("code", "STARTS_WITH", "a")]}]}
    assert ids(filter_frame(frame, tree)) == [1, 4]


def test_empty_group_is_no_filter(frame):
    assert ids(filter_frame(frame, {"type": "group", "logic": "AND", "conditions": []})) == [1, 2, 3, 4]


def test_lenient_drop_widens(frame):
    tree = {"type": "group", "logic": "AND", "conditions": [
        leaf("value", "GREATER_THAN", 10), leaf("9bad", "EQUALS", 1), leaf("value", "LIKE", "x")]}
    assert ids(filter_frame(frame, tree)) == [1, 3]


def test_strict_raises(frame):
    ctx = FilterContext(frame.schema, strict=True)
    with pytest.raises(FilterError):
        compile_filter(leaf("value", "LIKE", "x"), ctx)


def test_unknown_column_raises(frame):
    with pytest.raises(UnknownColumnError):
        filter_frame(frame, leaf("nosuch", "EQUALS", 1))


def test_field_name_mapping(frame):
    df = frame.withColumnRenamed("event_type", "event_type")
    assert ids(filter_frame(df, leaf("_event_type", "EQUALS", "view"))) == [3]
    assert ids(filter_frame(df, leaf("_data.CODE", "EQUALS", "b2"))) == [3]


def test_filters_reach_the_scan(spark):
    from thresher.plans.common import FLAGSHIP_RULE
    from thresher.operators.backtest import backtest

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = backtest(ev, FLAGSHIP_RULE, "2024-01-01 00:00", "2024-01-10 00:00")._jdf.queryExecution() \
        .executedPlan().toString()
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "GreaterThanOrEqual(ts" in pushed
    assert "WindowGroupLimit" in plan


def test_in_list_of_mixed_kinds(spark):
    from thresher.functions.predicates import filter_frame

    df = spark.createDataFrame([("5",), ("a",), ("5.0",), ("true",), ("b",)], "x string")
    tree = {"type": "condition", "field": "x", "operator": "IN", "value": [5, "a", True]}
    assert sorted(r.x for r in filter_frame(df, tree).collect()) == ["5", "5.0", "a", "true"]


def test_epoch_out_of_range_drops_the_leaf(spark):
    from thresher.functions.predicates import filter_frame

    df = spark.range(3).selectExpr("id", "timestamp_ntz'2024-01-01 00:00:00' ts")
    tree = {"type": "condition", "field": "ts", "operator": "DATE_BEFORE", "value": "99999999999999999", "format": "EPOCH_MILLIS"}
    assert filter_frame(df, tree).count() == 3


def test_contains_on_small_doubles(spark):
    from thresher.functions.predicates import filter_frame

    df = spark.createDataFrame([(0.0005,), (15000000.25,), (2.0,)], "x double")
    tree = {"type": "condition", "field": "x", "operator": "CONTAINS", "value": "0.0005"}
    assert [r.x for r in filter_frame(df, tree).collect()] == [0.0005]
