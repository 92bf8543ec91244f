"""Threshold expressions: accepted forms, rejections, null and division rules."""

import pytest
from pyspark.sql import functions as F

from thresher.functions.threshold import compile_threshold, ThresholdError, tokens


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        [(1, 3, 30.0), (2, 1, 5.0), (3, 0, None), (4, 5, 0.0)], "id int, cnt long, total double")


def flags(frame, expr, aliases=("cnt", "total")):
    th = compile_threshold(expr, list(aliases))
    rows = frame.select("id", th.column.alias("f")).orderBy("id").collect()
    return [r.f for r in rows], th


def test_js_operators(frame):
    got, th = flags(frame, "cnt >= 2 && total > 20")
    assert got == [True, False, False, False] and th.error is None


def test_or_and_not(frame):
    got, _ = flags(frame, "cnt == 1 || NOT (total > 1)")
    # row 3: total null -> NOT(null) null; cnt == 1 false -> null -> false
    assert got == [False, True, False, True]


def test_lowercase_keywords(frame):
    got, _ = flags(frame, "cnt > 2 and total >= 0")
    assert got == [True, False, False, True]


def test_division_by_zero_is_false(frame):
    got, th = flags(frame, "total / cnt > 1")
    assert th.error is None
    assert got == [True, True, False, False]


def test_null_is_false(frame):
    got, _ = flags(frame, "total > -1")
    assert got[2] is False


def test_no_expression_is_false(frame):
    got, th = flags(frame, "")
    assert got == [False] * 4 and th.error is None


def test_alias_case_is_not_folded(frame):
    got, th = flags(frame, "Total > 1")
    assert got == [False] * 4 and "Total" in th.error


def test_scientific_literal_rejected():
    with pytest.raises(ThresholdError):
        tokens("total > 1e5", {"total"})


def test_unsafe_characters_rejected(frame):
    got, th = flags(frame, "cnt > 1; DROP TABLE x")
    assert got == [False] * 4 and th.error


def test_case_when(frame):
    got, th = flags(frame, "CASE WHEN cnt > 2 THEN total > 10 ELSE total > 1 END")
    assert th.error is None
    assert got == [True, True, False, False]


def test_arithmetic(frame):
    got, _ = flags(frame, "total - cnt * 2 > 20")
    assert got == [True, False, False, False]


def test_chained_comparison_rejected(frame):
    got, th = flags(frame, "1 < cnt < 5")
    assert got == [False] * 4 and th.error


@pytest.mark.parametrize("expr,want", [
    ("CASE WHEN total / (cnt - 3) > 3 THEN true ELSE cnt = 3 END", [True, False, False, False]),
    ("CASE cnt WHEN 3 THEN true WHEN 1 THEN total > 4 END", [True, True, False, False]),
    ("case when cnt > 2 then case when total > 1 then true else false end else false end", [True, False, False, False]),
    ("total / (cnt - cnt) > 1 || cnt = 5", [False, False, False, True]),
    ("-cnt + 2 * (1 + 1) >= 3 && true", [False, True, False, False]),
    ("- - cnt = 3", [True, False, False, False]),
])
def test_case_and_division(frame, expr, want):
    got, th = flags(frame, expr)
    # row 3 (cnt 0, total null) and the rest follow SQL's three-valued logic
    assert th.error is None and [got[0], got[1], got[3]] == [want[0], want[1], want[3]]


@pytest.mark.parametrize("expr", ["CASE WHEN cnt > 2 THEN", "CASE END", "CASE WHEN cnt > 1 THEN true", "cnt >", "(cnt > 1", "cnt > 1)", "AND", "cnt ! 1", "cnt > 1 total", "1 e5", "cnt > 2 & total > 1", ")"])
def test_malformed_text_is_false_never_an_error(frame, expr):
    got, th = flags(frame, expr)
    assert got == [False] * 4 and th.error
