"""Plans over the stored rule results (derived from events)."""

from __future__ import annotations

from thresher.operators.livestate import upsert
from thresher.operators.results import group_detail, live_results, results_in_range, results_last_hours, top_groups
from thresher.plans.common import MESSAGES_CTE, NOW_UTC, messages
from thresher.plans.registry import register, rounded
from thresher.session import files_for, scratch_path
from thresher.sources.latest_table import LatestTable

COLS = ["ruleId", "groupKey", "windowStart", "windowEnd", "producedAt", "cnt", "total", "thresholdBreached",
        "isFinal", "seq"]
_SEL = ", ".join(COLS)
TOP_START, TOP_END = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


@register("results_live_latest", covers="S4 F20 O2", sql=f"""
WITH {MESSAGES_CTE}
SELECT {_SEL} FROM latest WHERE ruleId = 'R_USER_DAY'""")
def results_live_latest(spark, sf_dir):
    return live_results(messages(spark, sf_dir), "R_USER_DAY").select(*COLS)


@register("results_live_newest", covers="O2", sql=f"""
WITH {MESSAGES_CTE}
SELECT {_SEL} FROM latest WHERE ruleId = 'R_USER_DAY'
ORDER BY windowStart DESC, ruleId, groupKey LIMIT 100""")
def results_live_newest(spark, sf_dir):
    """The newest hundred windows of a rule, on request."""
    return live_results(messages(spark, sf_dir), "R_USER_DAY", 100).select(*COLS)


def _latest_table(spark, sf_dir) -> LatestTable:
    """The messages as a stream in order of arrival, some micro-batches long,
    folded into a table of latest versions."""
    rows = messages(spark, sf_dir).select(*COLS)
    files = files_for(-(-rows.count() // 8))  # as many tasks as a micro-batch is large
    rows.repartitionByRange(8 * files, "seq").write.parquet(inbox := scratch_path(spark, "results-inbox"))
    table = LatestTable(spark, scratch_path(spark, "results-latest"), rows.schema, buckets=4, base_every=3)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 * files).parquet(inbox)
    stream.writeStream.foreachBatch(table.fold).option("checkpointLocation", scratch_path(spark, "results-checkpoint")) \
        .trigger(availableNow=True).start().awaitTermination()
    return table


@register("results_latest_incremental", covers="S4 D6", sql=f"""
WITH {MESSAGES_CTE}
SELECT {_SEL} FROM latest""")
def results_latest_incremental(spark, sf_dir):
    """Every key's latest version, from a base and deltas by cell."""
    return _latest_table(spark, sf_dir).read().select(*COLS)


@register("results_newest_incremental", covers="O2 S4", sql=f"""
WITH {MESSAGES_CTE}
SELECT {_SEL} FROM latest WHERE ruleId = 'R_USER_DAY'
ORDER BY windowStart DESC, ruleId, groupKey LIMIT 100""")
def results_newest_incremental(spark, sf_dir):
    """The newest hundred windows of a rule, read from its newest days alone."""
    return _latest_table(spark, sf_dir).newest("R_USER_DAY", 100).select(*COLS)


@register("results_multi_last_hours", covers="F21 O3 A18", sql=f"""
WITH {MESSAGES_CTE}
SELECT {_SEL} FROM latest
WHERE ruleId IN ('R_USER_DAY', 'R_TYPE_HOUR')
  AND strptime(windowStart, '%Y-%m-%d %H:%M:%S') - INTERVAL 330 MINUTE >= TIMESTAMP '2024-01-28 00:00:00'""")
def results_multi_last_hours(spark, sf_dir):
    df = results_last_hours(messages(spark, sf_dir), ["R_USER_DAY", "R_TYPE_HOUR"], 72, NOW_UTC)
    return df.select(*COLS)


@register("results_range", covers="F22 O3 A18", sql=f"""
WITH {MESSAGES_CTE}
SELECT {_SEL} FROM latest
WHERE ruleId IN ('R_TYPE_HOUR', 'R_NONE')
  AND strptime(windowStart, '%Y-%m-%d %H:%M:%S') >= TIMESTAMP '2024-01-10 00:00:00'
  AND strptime(windowStart, '%Y-%m-%d %H:%M:%S') <= TIMESTAMP '2024-01-20 12:00:00'""")
def results_range(spark, sf_dir):
    df = results_in_range(messages(spark, sf_dir), ["R_TYPE_HOUR", "R_NONE"], "2024-01-10", "2024-01-20T12:00")
    return df.select(*COLS)


def _top_sql(offset: int) -> str:
    return f"""
WITH {MESSAGES_CTE}
SELECT groupKey, totalWindows, breachedWindows,
       round(CASE WHEN totalWindows > 0 THEN CAST(breachedWindows AS DOUBLE) / totalWindows * 100 ELSE 0 END, 4)
         AS breachRate, lastSeen
FROM (SELECT groupKey, COUNT(*) AS totalWindows, CAST(SUM(CAST(thresholdBreached AS BIGINT)) AS BIGINT) AS breachedWindows,
             MAX(windowEnd) AS lastSeen
      FROM latest WHERE ruleId = 'R_USER_DAY'
        AND strptime(windowStart, '%Y-%m-%d %H:%M:%S') >= TIMESTAMP '{TOP_START}'
        AND strptime(windowStart, '%Y-%m-%d %H:%M:%S') <= TIMESTAMP '{TOP_END}'
      GROUP BY groupKey) g
ORDER BY breachedWindows DESC, totalWindows DESC, groupKey LIMIT 50 OFFSET {offset}"""


@register("results_top_groups", covers="A17 C13 O5", sql=_top_sql(0))
def results_top_groups(spark, sf_dir):
    return rounded(top_groups(messages(spark, sf_dir), "R_USER_DAY", TOP_START, TOP_END))


@register("results_top_groups_page2", covers="A17 O5", sql=_top_sql(50))
def results_top_groups_page2(spark, sf_dir):
    return rounded(top_groups(messages(spark, sf_dir), "R_USER_DAY", TOP_START, TOP_END, 50, 50))


@register("results_group_detail", covers="F23 O4", sql=f"""
WITH {MESSAGES_CTE}
SELECT {_SEL} FROM latest WHERE ruleId = 'R_USER_DAY' AND groupKey = '42'
  AND strptime(windowStart, '%Y-%m-%d %H:%M:%S') >= TIMESTAMP '{TOP_START}'
  AND strptime(windowStart, '%Y-%m-%d %H:%M:%S') <= TIMESTAMP '{TOP_END}'""")
def results_group_detail(spark, sf_dir):
    return group_detail(messages(spark, sf_dir), "R_USER_DAY", "42", TOP_START, TOP_END).select(*COLS)


@register("results_bootstrap", covers="S7", sql=f"""
WITH {MESSAGES_CTE},
boot AS (SELECT * FROM latest
         WHERE strptime(windowStart, '%Y-%m-%d %H:%M:%S') - INTERVAL 330 MINUTE >= TIMESTAMP '2024-01-28 00:00:00')
SELECT ruleId, groupKey, windowStart, cnt, isFinal, seq, seq AS first_seq FROM boot""")
def results_bootstrap(spark, sf_dir):
    """Start-up state: every rule's rows of the last 72 hours,
    upserted into an empty view."""
    boot = results_last_hours(messages(spark, sf_dir), [], 72, NOW_UTC)
    return upsert(boot).select("ruleId", "groupKey", "windowStart", "cnt", "isFinal", "seq", "first_seq")
