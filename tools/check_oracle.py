"""Run registered queries against their SQL on DuckDB and report differences.

    python tools/check_oracle.py [--sf DIR] [--only a,b] [--module text]
"""

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from opsloom.session import TABLES, build_session


def _norm(v):
    if isinstance(v, bool):
        return v
    if hasattr(v, "is_finite") and not isinstance(v, float):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


def compare(df, sql, folder):
    cols = sorted(df.columns)
    t0 = time.time()
    got = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    spent = time.time() - t0
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if cols != sorted(names):
        return f"columns differ: {cols} vs {sorted(names)}", 0, spent
    at = [names.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in at) for r in want]
    a, b = Counter(map(repr, got)), Counter(map(repr, want))
    if a == b:
        return None, len(got), spent
    left, right = list((a - b).elements()), list((b - a).elements())
    return (f"rows {len(got)} vs {len(want)}; {len(left)} differ; cols {cols}\n   spark {sorted(left)[:3]}\n"
            f"   duck  {sorted(right)[:3]}")[:1800], len(got), spent


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--module", default="")
    ap.add_argument("--cpus", default="8")
    args = ap.parse_args()
    from opsloom.catalogue import registry

    if args.module:
        for m in args.module.split(","):
            __import__(f"opsloom.catalogue.{m}")
    else:
        registry._load()
    spark = build_session("check", f"local[{args.cpus}]", **{"spark.sql.shuffle.partitions": "8",
                                                           "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    only = set(filter(None, args.only.split(",")))
    bad = 0
    for name, q in registry.REGISTRY.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = q.run(registry.Tables(spark, args.sf))
            if q.sql:
                err, n, spent = compare(df, q.sql, args.sf)
            else:
                n, err = len(df.collect()), None
                spent = time.time() - t0
        except Exception as exc:  # noqa: BLE001
            err, n, spent = f"{type(exc).__name__}: {str(exc)[:1500]}", -1, 0
        bad += bool(err)
        print(f"{'FAIL' if err else 'ok  '} {name:28s} {n:7d} rows {spent:6.2f}s of {time.time() - t0:6.2f}s"
              f"{'' if q.sql else ' (rows only)'}{chr(10) + '   ' + err if err else ''}", flush=True)
    print("failures:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
