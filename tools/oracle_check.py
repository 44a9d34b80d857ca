"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


EXACT = False


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v) if EXACT else float(f"{v:.12g}")
    if isinstance(v, decimal.Decimal):
        return f"decimal:{v}" if EXACT else float(f"{float(v):.12g}")
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keys = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha1("\n".join(keys).encode()).hexdigest(), keys


def compare(spark, sf_dir, names=None, verbose=True):
    import importlib
    entry = importlib.import_module("__spark_entry__")
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:400]}"
            print(name, results[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = f"rows-only {len(srows)}"
            print(f"{name:32s} {results[name]} spark={ts:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = f"DUCK ERROR {str(e)[:400]}"
            print(name, results[name], flush=True)
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        hs, ks = digest(scols, srows)
        hd, kd = digest(dcols, drows)
        ok = ok_cols and len(srows) == len(drows) and hs == hd
        results[name] = "OK" if ok else "MISMATCH"
        print(f"{name:32s} {results[name]:8s} rows={len(srows)}/{len(drows)} "
              f"cols_ok={ok_cols} spark={ts:.1f}s", flush=True)
        if not ok and verbose:
            if not ok_cols:
                print("  spark cols:", sorted(scols))
                print("  duck  cols:", sorted(dcols))
            else:
                a, b = set(ks), set(kd)
                for x in sorted(a - b)[:3]:
                    print("  spark only:", x[:600])
                for x in sorted(b - a)[:3]:
                    print("  duck  only:", x[:600])
    return results


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from waypoint.session import local_session
    args = [a for a in sys.argv[1:] if a != "--exact"]
    EXACT = "--exact" in sys.argv
    sf = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or None
    spark = local_session(8, 8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v != "OK" and not v.startswith("rows-only")}
    print(f"\n{len(res) - len(bad)}/{len(res)} ok; bad: {sorted(bad)}")
