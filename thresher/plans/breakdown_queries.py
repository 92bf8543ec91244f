"""Breakdown plans over the events matched by one rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from thresher.functions.timeutil import resolve_range
from thresher.operators.backtest import rule_matches
from thresher.operators.breakdown import STANDIN_FLAGS, category_top, location_top, modality_mix, score_histogram
from thresher.plans.common import MATCHED_SQL, cond, events, rule, table, whole_range
from thresher.plans.registry import register

BREAKDOWN_RULE = rule("R_BD", ["user_id"], 86400000, [("n", "event_id", "COUNT")], "",
                      cond("value", "GREATER_THAN", 5))
_M = f"(SELECT * FROM {MATCHED_SQL} mm WHERE value > 5)"


def _matched(spark, sf_dir):
    ev = events(spark, sf_dir)
    start, end = resolve_range(*whole_range(ev))
    return rule_matches(ev, BREAKDOWN_RULE, start, end)


@register("breakdown_modality", covers="A13 V20", sql=f"""
SELECT label, count FROM (
  SELECT CAST(round_even(COALESCE(SUM(flag_signup), 0), 0) AS BIGINT) AS "Signup",
         CAST(round_even(COALESCE(SUM(flag_purchase), 0), 0) AS BIGINT) AS "Purchase",
         CAST(round_even(COALESCE(SUM(flag_error), 0), 0) AS BIGINT) AS "Error",
         CAST(round_even(COALESCE(SUM(flag_view), 0), 0) AS BIGINT) AS "View",
         CAST(round_even(COALESCE(SUM(flag_click), 0), 0) AS BIGINT) AS "Click"
  FROM {_M} m) s
UNPIVOT (count FOR label IN ("Signup", "Purchase", "Error", "View", "Click"))""")
def breakdown_modality(spark, sf_dir):
    return modality_mix(_matched(spark, sf_dir), STANDIN_FLAGS)


@register("breakdown_outcome_top10", covers="A14 O6", sql=f"""
SELECT COALESCE(event_type, 'UNKNOWN') AS label, COUNT(*) AS count FROM {_M} m
GROUP BY 1 ORDER BY count DESC, label LIMIT 10""")
def breakdown_outcome_top10(spark, sf_dir):
    return category_top(_matched(spark, sf_dir), F.col("event_type"))


@register("breakdown_geo_top10", covers="A15 O6", sql=f"""
SELECT COALESCE(n.n_name, 'UNKNOWN') AS label, COUNT(*) AS count
FROM {_M} m LEFT JOIN customer c ON c.c_custkey = m.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY 1 ORDER BY count DESC, label LIMIT 10""")
def breakdown_geo_top10(spark, sf_dir):
    return location_top(_matched(spark, sf_dir), "user_id", table(spark, sf_dir, "customer"), "c_custkey",
                        "c_nationkey", places=table(spark, sf_dir, "nation"), place_key="n_nationkey",
                        place_label="n_name")


@register("breakdown_score_histogram", covers="A16 C4 V15 O7", sql=f"""
SELECT CAST(b AS VARCHAR) || '-' || CAST(b + 10 AS VARCHAR) AS label, COUNT(*) AS count
FROM (SELECT CAST(FLOOR(value / 10) * 10 AS DOUBLE) AS b FROM {_M} m WHERE value IS NOT NULL) t
GROUP BY b""")
def breakdown_score_histogram(spark, sf_dir):
    return score_histogram(_matched(spark, sf_dir), "value").drop("bucket_start")
