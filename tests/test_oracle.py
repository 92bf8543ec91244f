"""Every registered plan against its DuckDB oracle SQL on sf0.001 (the
driver runs the same comparison at sf0.01)."""

import math
import os

import duckdb
import pytest

from thresher.plans.registry import load_all

SF = "/root/testdata/sf0.001"
REG = load_all()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(n for n, r in REG.items() if r.sql))
def test_plan_matches_oracle(spark, con, name):
    r = REG[name]
    df = r.fn(spark, SF)
    cols, rows = df.columns, [tuple(x) for x in df.collect()]
    res = con.execute(r.sql)
    dcols, drows = [d[0] for d in res.description], res.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    assert _rows(cols, rows) == _rows(dcols, drows)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() >= 0 and "threshold_met" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


ZONE_SAMPLE = ["backtest_user_daily", "filter_dates", "dedup_latest_event", "results_multi_last_hours",
               "live_prune_leading", "consume_delay_histogram", "stream_tumbling_final", "access_audit_latest", "stream_partial_final_late", "stream_multi_rule"]


@pytest.mark.parametrize("name", ZONE_SAMPLE)
def test_session_zone_does_not_matter(spark, con, name):
    """Event times are UTC wall clocks (TIMESTAMP_NTZ); no plan may read the
    session time zone."""
    r = REG[name]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = r.fn(spark, SF)
        cols, rows = df.columns, [tuple(x) for x in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    res = con.execute(r.sql)
    dcols, drows = [d[0] for d in res.description], res.fetchall()
    assert _rows(cols, rows) == _rows(dcols, drows)
