"""Run queries beside their SQL twins and compare the values.

usage: python tools/check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

from evisift.plans import catalog
from evisift.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "16", "spark.driver.memory": "20g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            t = time.time()
            got = fn(spark, sf).toPandas()
            spent = time.time() - t
            sql = catalog.ORACLES.get(name)
            if sql is None:
                print(f"rows {name:36s} {len(got):8d} {spent:6.1f}s", flush=True)
                continue
            con = duckdb.connect()
            for table in TABLES:
                con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
            t = time.time()
            want = con.execute(sql).df()
            duck = time.time() - t
            a, b = canonical(got), canonical(want)
            ok = list(a.columns) == list(b.columns) and len(a) == len(b)
            note = ""
            if ok:
                for c in a.columns:
                    x, y = a[c], b[c]
                    if pd.api.types.is_numeric_dtype(x) and pd.api.types.is_numeric_dtype(y):
                        same = ((x.astype(float) - y.astype(float)).abs() < 1e-12) | (x.isna() & y.isna())
                    else:
                        same = (x.astype(str) == y.astype(str)) | (x.isna() & y.isna())
                    if not same.all():
                        ok = False
                        i = same.idxmin()
                        note = f"{c}[{i}]: {x[i]!r} != {y[i]!r} ({(~same).sum()} rows)"
                        break
                    if x.dtype.kind != y.dtype.kind:
                        note = f"type {c}: {x.dtype} vs {y.dtype}"
            else:
                note = f"{list(a.columns)}/{len(a)} vs {list(b.columns)}/{len(b)}"
            bad += not ok
            print(f"{'ok  ' if ok else 'DIFF'} {name:36s} {len(got):8d} {spent:6.1f}s duck {duck:5.1f}s {note}", flush=True)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name:36s} {str(exc)[:600]}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
