"""Compare registered queries with their SQL on DuckDB:  python tools/check.py [sf_dir] [name-or-module prefixes...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelspark.plans import ORACLES, QUERIES  # noqa: E402
from panelspark.session import get_session  # noqa: E402


def duck(sf: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        v = pdf[c]
        if pd.api.types.is_bool_dtype(v):
            pdf[c] = v.astype(float)
        elif pd.api.types.is_numeric_dtype(v):
            pdf[c] = v.astype(float)
        elif pd.api.types.is_datetime64_any_dtype(v):
            pdf[c] = v.astype("datetime64[us]").astype(str).str.replace("NaT", "None")
        else:
            pdf[c] = v.map(lambda x: "None" if x is None or x is pd.NaT or (isinstance(x, float) and x != x)
                           else str(pd.Timestamp(x)) if hasattr(x, "year") else str(list(x)) if isinstance(x, (np.ndarray, list)) else str(x))
    return pdf.sort_values(list(pdf.columns), kind="mergesort").reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"COLUMNS spark-only={sorted(set(a) - set(b))} sql-only={sorted(set(b) - set(a))}"
    if len(a) != len(b):
        return f"ROWS spark={len(a)} sql={len(b)}"
    a, b = norm(a), norm(b)
    bad = []
    for c in a.columns:
        if a[c].dtype != b[c].dtype:
            bad.append(f"{c}: dtype {a[c].dtype} / {b[c].dtype} e.g. {a[c].head(2).tolist()} {b[c].head(2).tolist()}")
            continue
        ne = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if ne.any():
            i = ne.idxmax()
            bad.append(f"{c}: {int(ne.sum())} differ, e.g. {a[c][i]!r} / {b[c][i]!r}")
    return "OK" if not bad else "VALUES " + "; ".join(bad[:4])


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    want = [a for a in args if "/" not in a]
    spark = get_session(master="local[8]", shuffle=8)
    con = duck(sf)
    fails = 0
    for name, fn in QUERIES.items():
        mod = fn.__module__.rsplit(".", 1)[-1]
        if want and not any(name.startswith(w) or mod == w for w in want):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            a = df.toPandas()
            ts = time.time() - t
            if name not in ORACLES:
                print(f"{name:36s} rows-only {len(a):7d} rows {ts:6.2f}s", flush=True)
                continue
            t = time.time()
            b = con.execute(ORACLES[name]).df()
            res = compare(a, b)
            allnull = [c for c in a.columns if a[c].isna().all()]
            note = f" all-null={allnull}" if allnull and len(a) else ""
            print(f"{name:36s} {res} ({len(a)} rows) spark {ts:.2f}s duck {time.time() - t:.2f}s{note}", flush=True)
            fails += res != "OK"
        except Exception as e:  # report and go on
            fails += 1
            print(f"{name:36s} ERROR {type(e).__name__}: {" ".join(str(e).split())[:400]}", flush=True)
    print("failures:", fails)
    spark.stop()


if __name__ == "__main__":
    main()
