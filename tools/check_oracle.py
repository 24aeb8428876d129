"""Run each registered Spark query and its DuckDB oracle; compare row count,
column names and an order-insensitive hash of the values.

usage: python tools/check_oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from ordersight.session import get_session  # noqa: E402
from ordersight.plans.catalog import all_oracles, all_queries  # noqa: E402
from ordersight.sources.star import TABLES  # noqa: E402


def norm(v, digits=None):
    if v is None:
        return "None"
    if isinstance(v, float):
        if math.isnan(v):
            return "None"
        return repr(round(v, digits)) if digits is not None else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v)) if digits is None else repr(round(float(v), digits))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x, digits) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat()
    return str(v)


def digest(cols, rows, digits=None):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keys = sorted("|".join(norm(r[i], digits) for i in order) for r in rows)
    return hashlib.md5("\n".join(keys).encode()).hexdigest(), keys


def main():
    args = sys.argv[1:]
    plain = "--plain" in args
    args = [a for a in args if a != "--plain"]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    keys = [a for a in args if not os.path.isdir(a)]
    if plain:  # a session as a driver would build it, without the engine's defaults
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]")
                 .config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    else:
        spark = get_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, oracles = all_queries(), all_oracles()
    keys = keys or list(qs)
    bad = []
    for k in keys:
        t0 = time.time()
        try:
            sdf = qs[k](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad.append(k)
            continue
        ts = time.time() - t0
        if k not in oracles:
            print(f"{k:32s} rows={len(srows):6d} (no oracle) {ts:.2f}s")
            continue
        try:
            rel = con.sql(oracles[k])
            ocols = rel.columns
            orows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} ORACLE-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad.append(k)
            continue
        same_cols = sorted(scols) == sorted(ocols)
        hs, ks = digest(scols, srows)
        ho, ko = digest(ocols, orows)
        exact = hs == ho
        approx = digest(scols, srows, 6)[0] == digest(ocols, orows, 6)[0]
        status = "OK" if (same_cols and exact and len(srows) == len(orows)) else (
            "APPROX" if same_cols and approx else "MISMATCH")
        print(f"{k:32s} {status:8s} rows={len(srows)}/{len(orows)} cols={'ok' if same_cols else (sorted(scols), sorted(ocols))} {ts:.2f}s")
        if status != "OK":
            bad.append(k)
            diff_s = [x for x in ks if x not in set(ko)][:3]
            diff_o = [x for x in ko if x not in set(ks)][:3]
            print("   spark-only:", diff_s)
            print("   oracle-only:", diff_o)
    print("NOT OK:", bad)


if __name__ == "__main__":
    main()
