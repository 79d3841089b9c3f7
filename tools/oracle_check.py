"""Run registered queries in Spark and their oracle SQL in DuckDB; print one line per query.

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pageflow.plans.catalog import QUERIES  # noqa: E402
from pageflow.plans.check import compare, duckdb_connection  # noqa: E402
from pageflow.session import get_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or list(QUERIES)
    spark = get_session("local[8]")
    con = duckdb_connection(sf)
    bad = 0
    for n in names:
        build, sql = QUERIES[n]
        t0 = time.time()
        if sql is None:
            rows = build(spark, sf).count()
            print(f"{n:24s} rows-only {rows} ({time.time() - t0:.1f}s)", flush=True)
            continue
        try:
            r = compare(spark, n, build, sql, sf, con)
        except Exception as e:  # report and continue
            bad += 1
            print(f"{n:24s} ERROR {type(e).__name__}: {str(e)[:400]}", flush=True)
            continue
        status = "OK" if r["ok"] else "MISMATCH"
        bad += not r["ok"]
        print(f"{n:24s} {status} rows={r['rows']} cols={r['cols_match']} hash={r['hash_match']} ({time.time() - t0:.1f}s)", flush=True)
        if not r["ok"]:
            print("   spark cols", r["columns"][0], "duck cols", r["columns"][1])
            ss, dd = set(map(repr, r["spark_rows"])), set(map(repr, r["duck_rows"]))
            print("   only spark:", list(ss - dd)[:2])
            print("   only duck :", list(dd - ss)[:2])
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
