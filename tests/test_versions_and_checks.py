"""Saving rule versions, status changes and access checks on hand-made rows."""

from pyspark.sql import functions as F

from thresher.functions.timeutil import parse_lenient_text
from thresher.operators.access import audit_latest, change_check
from thresher.operators.livestate import recent_anomalies
from thresher.operators.rulestore import apply_new_versions, apply_status_changes, lifecycle, numbered, publish_records, save_versions

HEADERS = "id long, rule_id string, version long, is_active boolean, name string, status string"


def headers(spark):
    return spark.createDataFrame([(1, "A", 1, False, "a", "DRAFT"), (2, "B", 1, True, "b", "ACTIVE"), (7, "A", 2, True, "a2", "PAUSED")], HEADERS)


def test_new_versions_of_old_and_new_rules(spark):
    drafts = spark.createDataFrame([("A", "first", 1), ("A", "second", 2), ("C", "c", 1)], "rule_id string, name string, seq int")
    rows = {(r.rule_id, r.version): r for r in apply_new_versions(headers(spark), drafts).collect()}
    assert set(rows) == {("A", 1), ("A", 2), ("A", 3), ("B", 1), ("C", 1)}
    assert rows["A", 3].name == "second" and rows["A", 3].is_active and not rows["A", 2].is_active
    assert rows["B", 1].is_active and rows["B", 1].id == 2 and rows["C", 1].status == "DRAFT"
    ids = [r.id for r in rows.values()]
    assert len(set(ids)) == 5 and min(rows["A", 3].id, rows["C", 1].id) > 7


def test_side_tables_follow_the_new_row_id(spark):
    windows = spark.createDataFrame([(2, "TUMBLING", 1000)], "rule_row_id long, window_type string, window_size_ms long")
    sides = spark.createDataFrame([("C", "SLIDING", 5000)], "rule_id string, window_type string, window_size_ms long")
    out = save_versions({"headers": headers(spark), "window_configs": windows}, spark.createDataFrame([("C", "c")], "rule_id string, name string"), {"window_configs": sides})
    new = out["headers"].where("rule_id = 'C'").first()
    assert {(r.rule_row_id, r.window_type) for r in out["window_configs"].collect()} == {(2, "TUMBLING"), (new.id, "SLIDING")}


def test_numbers_have_no_gaps(spark):
    df = numbered(spark.range(5000).select(F.col("id").cast("string").alias("rule_id")), "rule_id")
    assert sorted(r["__n"] for r in df.collect()) == list(range(1, 5001))


def test_last_status_change_counts_and_rows_stay_single(spark):
    changes = spark.createDataFrame([("B", "PAUSED", 1), ("B", "DELETED", 2), ("A", "ACTIVE", 5), ("A", "PAUSED", 4), ("Z", "ACTIVE", 1)], "rule_id string, status string, seq int")
    rows = {r.id: r for r in apply_status_changes(headers(spark), changes).collect()}
    assert len(rows) == 3 and rows[2].status == "DELETED" and not rows[2].is_active
    assert rows[7].status == "ACTIVE" and rows[1].status == "DRAFT"


def test_tombstones_only_for_rules_once_active(spark):
    log = [("A", 1, "CREATE"), ("A", 2, "DELETE"), ("B", 1, "CREATE"), ("B", 2, "PUBLISH"), ("B", 3, "PAUSE"), ("B", 900_000, "DELETE")]
    states = lifecycle(spark.createDataFrame(log, "rule_id string, seq long, action string"))
    assert {r.rule_id: (r.status, r.ever_active) for r in states.collect()} == {"A": ("DELETED", False), "B": ("DELETED", True)}
    docs = spark.createDataFrame([], "rule_id string, status string, published boolean, window_type string, window_size_ms long, slide_ms long, expression string")
    assert [r.key for r in publish_records(docs, states).collect()] == ["B"]


def access(spark, admins):
    users = spark.createDataFrame([(i, f"u{i}", f"u{i}", "ACTIVE") for i in range(6)], "id long, email string, display_name string, status string")
    roles = spark.createDataFrame([(1, "SUPER_ADMIN"), (2, "READ_ONLY_ANALYST")], "id int, name string")
    held = spark.createDataFrame([(i, 1 if i in admins else 2) for i in range(6)], "user_id long, role_id int")
    return users, held, roles


def decisions(spark, admins, proposals):
    df = spark.createDataFrame(proposals, "proposal_id long, target_id long, actor_id long, new_role string, new_status string")
    return {r.proposal_id: (r.self_edit, r.last_admin, r.allowed) for r in change_check(df, *access(spark, admins)).collect()}


def test_the_last_admin_of_a_batch_stays(spark):
    low = ("READ_ONLY_ANALYST", "ACTIVE")
    got = decisions(spark, {0, 1}, [(1, 0, 5, *low), (2, 1, 5, *low), (3, 1, 5, "SUPER_ADMIN", "DISABLED"), (4, 0, 5, *low), (5, 3, 5, *low), (6, 4, 4, *low)])
    assert got == {1: (False, False, True), 2: (False, True, False), 3: (False, True, False), 4: (False, False, True), 5: (False, False, True), 6: (True, False, False)}


def test_an_admin_outside_the_batch_lets_all_go(spark):
    low = ("READ_ONLY_ANALYST", "ACTIVE")
    got = decisions(spark, {0, 1, 2}, [(1, 0, 5, *low), (2, 1, 5, *low), (3, 2, 2, *low)])
    assert got == {1: (False, False, True), 2: (False, False, True), 3: (True, False, False)}


def test_audit_metadata_of_any_shape(spark):
    rows = [(1, '{"priority": "x", "total": 1.5}'), (2, "not json"), (3, None), (4, '{"total": "text", "other": [1]}')]
    df = spark.createDataFrame(rows, "id long, metadata string").selectExpr("id", "metadata", "1L actor_user_id", "'a' action", "'t' target_type", "'1' target_id", "timestamp_ntz'2024-01-01 00:00:00' created_at")
    got = {r.id: (r.priority, r.total) for r in audit_latest(df, {"priority": "string", "total": "double"}).collect()}
    assert got == {1: ("x", 1.5), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_a_busy_rule_does_not_hide_a_quiet_one(spark):
    rows = [("quiet", i) for i in range(5)] + [("busy", 100 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "ruleId string, seq long")
    got = recent_anomalies(df, ["quiet", "busy"], 3).collect()
    assert sorted((r.request_place, r.position, r.seq) for r in got) == [(1, 1, 2), (1, 2, 3), (1, 3, 4), (2, 1, 597), (2, 2, 598), (2, 3, 599)]


def test_time_text_forms():
    import datetime as dt

    import pytest

    assert parse_lenient_text("2024-01-01T05:30") == parse_lenient_text("2024-01-01T00:00:00Z") == parse_lenient_text("1704067200000") == dt.datetime(2024, 1, 1)
    assert parse_lenient_text("2024-01-01") == dt.datetime(2023, 12, 31, 18, 30) and parse_lenient_text(" ") is None
    with pytest.raises(ValueError):
        parse_lenient_text("yesterday")
