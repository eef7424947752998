"""Run registered queries in Spark and their oracle SQL in DuckDB; compare row count,
column names and an order-insensitive hash of rounded values (mirrors the driver's gate).

usage: python tools/check_oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tessera.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return f"{round(v, 6 if abs(v) < 1e6 else 4):.6f}"  # doubles of 1e9 have no six places of their own
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    from tessera.plans.registry import load_all
    from tessera.session import get_session, release_tracked

    spark = get_session("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    reg = load_all()
    bad = 0
    for name, q in sorted(reg.items()):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        release_tracked()
        try:
            df = q.fn(spark, sf)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = q.oracle()
        if sql is None:
            print(f"rows-only {name}: {len(rows)} rows {ts:.1f}s")
            continue
        try:
            res = con.execute(sql)
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL {name}: {str(e)[:400]}")
            bad += 1
            continue
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(ocols, orows)
        ok = sorted(cols) == sorted(ocols) and len(rows) == len(orows) and h1 == h2
        if ok:
            print(f"ok {name}: {len(rows)} rows {ts:.1f}s", flush=True)
        else:
            bad += 1
            print(f"MISMATCH {name}: spark {len(rows)} {sorted(cols)} / duck {len(orows)} {sorted(ocols)}")
            s1, s2 = set(l1), set(l2)
            d1 = sorted(s1 - s2)[:3]
            d2 = sorted(s2 - s1)[:3]
            print("   spark-only:", d1)
            print("   duck-only :", d2)
    print(f"done, {bad} bad")


if __name__ == "__main__":
    main()
