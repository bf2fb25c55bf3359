"""Run a registered query on Spark and its SQL oracle on DuckDB, and compare.

Mirrors the driver's check: row count, column names, and an order-insensitive
comparison of all values.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, name: str, sf_dir: str, con=None, verbose=True):
    from sensortracks.plans import ORACLES, QUERIES

    con = con or duck_connection(sf_dir)
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    dpdf = con.execute(ORACLES[name]).fetchdf()
    t2 = time.time()
    scols, srows = _rows(spdf)
    dcols, drows = _rows(dpdf)
    ok = scols == dcols and len(srows) == len(drows) and srows == drows
    if verbose:
        print(f"{name}: {'OK' if ok else 'MISMATCH'} rows spark={len(srows)} duck={len(drows)} "
              f"spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s", flush=True)
        if not ok:
            print("  cols", scols, dcols)
            diff_s = [r for r in srows if r not in set(drows)][:5]
            diff_d = [r for r in drows if r not in set(srows)][:5]
            print("  spark-only", diff_s)
            print("  duck-only ", diff_d)
    return ok


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from sensortracks.plans import ORACLES
    from sensortracks.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(ORACLES)
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck_connection(sf)
    bad = []
    for n in names:
        try:
            if not compare(spark, n, sf, con):
                bad.append(n)
        except Exception as e:  # report and go on
            print(f"{n}: ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
            bad.append(n)
    print("FAILED:", bad if bad else "none")
