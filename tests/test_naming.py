"""Rule text helpers."""

import pytest
from pyspark.sql import functions as F

from thresher.functions.timeutil import human_ms_col, parse_local_text, resolve_range
from thresher.spec import RuleSpec, column_for, validate_identifier


@pytest.mark.parametrize("ms,text", [(0, "0ms"), (-5, "0ms"), (500, "500ms"), (45000, "45s"), (300000, "5m"),
                                     (90000, "1m30s"), (7200000, "2h"), (3900000, "1h5m"), (3930000, "1h5m")])
def test_human_ms(spark, ms, text):
    assert spark.range(1).select(human_ms_col(F.lit(ms))).first()[0] == text


def test_names():
    assert column_for("_data.deviceCode") == "devicecode"
    assert column_for("_event_timestamp") == "event_timestamp"
    with pytest.raises(ValueError):
        validate_identifier("1abc")


def test_local_range():
    s, e = resolve_range("2024-01-01T05:30", "2024-01-02 05:30:00")
    assert str(s) == "2024-01-01 00:00:00" and str(e) == "2024-01-02 00:00:00"
    assert str(parse_local_text("2024-01-01 00:00")) == "2023-12-31 18:30:00"


def test_window_size_rules():
    assert RuleSpec.from_dict({"windowing": {}}).window.backtest_seconds() == 300
    assert RuleSpec.from_dict({"windowing": {"size_ms": 999}}).window.backtest_seconds() == 1
    assert RuleSpec.from_dict({"windowing": {"size_ms": 86400000}}).window.backtest_seconds() == 86400


@pytest.mark.parametrize("grain", ["minute", "hour", "day"])
def test_prefilter_keeps_whole_dedup_groups(grain):
    import datetime as dt

    from thresher.sources.events import GRAIN_SECONDS, EventSource

    src = EventSource(dedup_grain=grain)
    s, e = dt.datetime(2024, 1, 5, 10, 17, 33), dt.datetime(2024, 1, 6, 3, 4, 5)
    lo, hi = src.prefilter_bounds(s, e)
    w = GRAIN_SECONDS[grain]
    assert lo <= s and (lo - dt.datetime(1970, 1, 1)).total_seconds() % w == 0
    assert hi >= e and ((hi + dt.timedelta(microseconds=1)) - dt.datetime(1970, 1, 1)).total_seconds() % w == 0


def test_validation_create_vs_update(spark):
    from thresher.operators.rulestore import validate_drafts

    df = spark.createDataFrame(
        [("a", "", "SLIDING", 1000, 5000, 1), ("b", "B", "NONE", 0, 0, 0), ("c", "C", "TUMBLING", 0, 0, 0)],
        "rule_id string, name string, window_type string, window_size_ms long, slide_ms long, n_aggs int")
    create = {r.rule_id: (r.name, list(r.errors)) for r in validate_drafts(df).collect()}
    assert create["a"] == ("a", ["windowing.slide_ms must not exceed windowing.size_ms for SLIDING windows"])
    assert create["b"][1] == [] and len(create["c"][1]) == 3
    update = {r.rule_id: list(r.errors) for r in validate_drafts(df, for_update=True).collect()}
    assert update["a"] == [] and len(update["c"]) == 2
