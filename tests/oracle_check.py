"""Run registered queries in Spark and their SQL oracles in DuckDB at one scale
and compare row count, column names and order-insensitive values.

usage: python tests/oracle_check.py [sf_dir] [name ...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tessera.session import get_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        rows.append(tuple("<null>" if (v is None or (isinstance(v, float) and v != v)) else
                          (round(float(v), 6) if isinstance(v, float) else str(v)) for v in r))
    return sorted(rows)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 and os.path.isdir(sys.argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if not os.path.isdir(a)]
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(sdf)} rows (no oracle) {ts:.1f}s")
            continue
        t0 = time.time()
        try:
            odf = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        to = time.time() - t0
        ok_cols = sorted(sdf.columns) == sorted(odf.columns)
        ok_n = len(sdf) == len(odf)
        a, b = (norm(sdf), norm(odf)) if ok_cols else ([], [1])
        ok = ok_cols and ok_n and a == b
        bad += not ok
        msg = "" if ok else f" cols={sorted(sdf.columns)} vs {sorted(odf.columns)} rows={len(sdf)} vs {len(odf)}"
        if ok_cols and ok_n and not ok:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            msg += f" first diffs={diff}"
        print(f"{'OK  ' if ok else 'DIFF'} {name}: {len(sdf)} rows spark {ts:.1f}s duckdb {to:.1f}s{msg}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
