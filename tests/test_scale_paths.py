"""The hot-group paths (chunked running sums, bucketed top-k, two-level
lifecycle fold) against plain single-task answers, with tiny chunk widths so
every group spans many chunks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from thresher.operators.rulestore import STATES, _transition, lifecycle
from thresher.operators.running import running_sums
from thresher.operators.topk import top_k_per_group
from thresher.sources.rule_tables import change_log


def test_running_sums_match_window(events_small):
    ev = events_small.select("event_id", "event_type", "value")
    got = running_sums(ev, ["event_type"], "event_id", {"n": F.lit(1).cast("long"), "s": F.col("value")},
                       chunk_width=37)
    w = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = ev.select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.sum("value").over(w).alias("s"),
                     (F.col("event_id") == F.max("event_id").over(Window.partitionBy("event_type"))).alias("last"))
    a = {r.event_id: (r["n"], round(r["s"], 6), r["__is_last"]) for r in got.collect()}
    b = {r.event_id: (r.n, round(r.s, 6), r.last) for r in want.collect()}
    assert a == b


def test_top_k_matches_row_number(events_small):
    got = top_k_per_group(events_small, ["event_type"], "event_id", 55, width=13)
    w = Window.partitionBy("event_type").orderBy(F.col("event_id").desc())
    want = events_small.withColumn("rn", F.row_number().over(w)).where("rn <= 55").drop("rn")
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())


def test_lifecycle_matches_sequential_fold(events_small):
    log = change_log(events_small)
    got = {r.rule_id: (r.status, r.version, r.actions) for r in lifecycle(log, chunk_width=7).collect()}
    want = {}
    for r in log.orderBy("rule_id", "seq").collect():
        st, v, n = want.get(r.rule_id, ("NONE", 0, 0))
        nxt, a, b = _transition(r.action, st)
        want[r.rule_id] = (nxt, a * v + b, n + 1)
    assert got == want
    assert set(s for s, _, _ in got.values()) <= set(STATES)
