"""Run registered plans on Spark and their oracle SQL on DuckDB; compare.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]

Prints one line per plan: rows on each side, column match, value match.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v if isinstance(v, (int, str, bool)) else str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    import duckdb

    from thresher.plans.registry import load_all
    from thresher.session import local_session

    reg = load_all()
    spark = local_session(8)
    if os.environ.get("SESSION_TZ"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["SESSION_TZ"])
    con = duckdb.connect()
    for t in TABLES:
        p = f"{args.sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    names = args.names or sorted(reg)
    bad = 0
    for name in names:
        r = reg[name]
        t0 = time.time()
        try:
            sdf = r.fn(spark, args.sf)
            cols = sdf.columns
            srows = [tuple(x) for x in sdf.collect()]
        except Exception as exc:  # noqa: BLE001
            print(f"{name:34s} SPARK ERROR {type(exc).__name__}: {str(exc)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if r.sql is None:
            print(f"{name:34s} spark_rows={len(srows):6d} (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(r.sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"{name:34s} DUCKDB ERROR {type(exc).__name__}: {str(exc)[:300]}")
            bad += 1
            continue
        same_cols = sorted(cols) == sorted(dcols)
        same_vals = same_cols and rows_of(cols, srows) == rows_of(dcols, drows)
        ok = same_cols and same_vals and len(srows) == len(drows)
        bad += 0 if ok else 1
        print(f"{name:34s} {'OK ' if ok else 'BAD'} spark={len(srows):6d} duck={len(drows):6d} "
              f"cols={'ok' if same_cols else (sorted(cols), sorted(dcols))} vals={'ok' if same_vals else 'DIFF'} {ts:.1f}s")
        if not ok and same_cols and os.environ.get("SHOW_DIFF"):
            a, b = set(rows_of(cols, srows)), set(rows_of(dcols, drows))
            print("   only spark:", sorted(a - b, key=repr)[:5])
            print("   only duck :", sorted(b - a, key=repr)[:5])
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
