"""Message normalisation, window-start parsing and value text."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from thresher.functions.timeutil import number_text, parse_window_start_col
from thresher.sources.results import normalise_results


def norm(spark, texts):
    raw = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, seq long")
    return {r.seq: r for r in normalise_results(raw).collect()}


def test_is_final_coercion(spark):
    rows = norm(spark, ['{"ruleId": "r", "isFinal": true}', '{"ruleId": "r", "isFinal": false}',
                        '{"ruleId": "r", "isFinal": "false"}', '{"ruleId": "r", "isFinal": 0.0}',
                        '{"ruleId": "r", "isFinal": 2}', '{"ruleId": "r", "isFinal": null}', '{"ruleId": "r"}'])
    assert [rows[i].isFinal for i in range(7)] == [True, False, True, False, True, True, True]


def test_breached_coercion(spark):
    rows = norm(spark, ['{"thresholdBreached": true}', '{"thresholdBreached": 1}', '{"thresholdBreached": 2}',
                        '{"thresholdBreached": null}', '{}', '{"thresholdBreached": "true"}'])
    assert [rows[i].thresholdBreached for i in range(6)] == [True, True, False, False, False, False]


def test_rule_id_fallback_is_key_presence(spark):
    rows = norm(spark, ['{"id": "a"}', '{"id": "a", "ruleId": null}', '{"id": ""}', '{"ruleId": "b", "id": "a"}'])
    assert [rows[i].ruleId for i in range(4)] == ["a", None, None, "b"]
    assert [rows[i].routeId for i in range(4)] == ["a", "a", "unknown", "b"]


def test_group_key_and_legacy_aggregates(spark):
    rows = norm(spark, ['{"entityValue": "u1", "aggregationResults": "{\\"cnt\\": 3, \\"total\\": 4.5}"}',
                        '{"groupKey": null, "entityValue": "u1"}', '{"aggResult": "not json"}'])
    assert (rows[0].groupKey, rows[0].cnt, rows[0].total) == ("u1", 3, 4.5)
    assert rows[1].groupKey is None and rows[2].cnt is None


def test_bad_json_dropped(spark):
    assert sorted(norm(spark, ['not json', '[1, 2]', '{"ruleId": "r"}'])) == [2]


@pytest.mark.parametrize("text,want", [
    ("2024-01-01 05:30:00", dt.datetime(2024, 1, 1, 0, 0)),       # local +05:30
    ("2024-01-01T05:30:00+05:30", dt.datetime(2024, 1, 1, 0, 0)),  # RFC 3339
    ("2024-01-01T00:00:00Z", dt.datetime(2024, 1, 1, 0, 0)),
    ("2024-01-01T00:00:00", dt.datetime(2024, 1, 1, 0, 0)),        # naive T form read as UTC
    ("yesterday", None),
])
def test_window_start_forms(spark, text, want):
    got = spark.createDataFrame([(text,)], "w string").select(parse_window_start_col(F.col("w"))).first()[0]
    assert got == want


def test_window_start_epoch_millis(spark):
    got = spark.createDataFrame([("", 1704067200000)], "w string, ms long") \
        .select(parse_window_start_col(F.col("w"), F.col("ms"))).first()[0]
    assert got == dt.datetime(2024, 1, 1)


def test_double_text(spark):
    values = [15000000.0, 123456789.25, 6.55, 1e16, 1.5e-5, 0.0005, -0.0001, 12345678.1234567, 1e15, 1e-300, -2.5e120, 0.0, 1234567890123456.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(number_text(F.col("x"), df.schema["x"].dataType)).collect()]
    assert got == [repr(v) for v in values]


def test_any_aggregate_shape_is_kept(spark):
    from thresher.sources.results import aggregate

    raw = ['{"ruleId": "a", "aggResult": {"hits": 3, "deep": {"x": 1}}, "windowStart": 1704067200000, "windowEnd": 1704067260000}',
           '{"ruleId": "a", "aggResult": "{\\"hits\\": 4}", "windowStart": 1704067260000}', '{"ruleId": "a", "aggResult": "broken {", "windowStart": "x"}', '{"ruleId": "a"}']
    df = normalise_results(spark.createDataFrame([(t, i) for i, t in enumerate(raw)], "value string, seq long"))
    rows = {r.seq: r for r in df.withColumn("hits", aggregate(F.col("aggResult"), "hits", "bigint")).collect()}
    assert [rows[i].hits for i in range(4)] == [3, 4, None, None]
    assert rows[2].aggResult == "broken {" and rows[3].aggResult is None and '"deep"' in rows[0].aggResult
    assert [rows[i].windowStart for i in range(4)] == ["1704067200000", "1704067260000", "x", None] and rows[0].windowEnd == "1704067260000"
