"""Scan every registered query's physical plan for patterns that do not scale.

Usage: python tools/plan_audit.py [sf_dir]
Reports, per query: cartesian / nested-loop joins, single-partition exchanges
(global windows or sorts), Python evaluation nodes, and the number of
exchanges.
"""

from __future__ import annotations

import re
import sys

PATTERNS = {
    "cartesian": r"CartesianProduct|BroadcastNestedLoopJoin",
    "single_partition": r"Exchange SinglePartition",
    "python": r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas",
}


def audit(spark, sf_dir):
    import importlib
    entry = importlib.import_module("__spark_entry__")
    out = {}
    for name, fn in entry.queries().items():
        df = fn(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        hits = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
        hits["exchanges"] = len(re.findall(r"Exchange ", plan))
        out[name] = hits
        flag = {k: v for k, v in hits.items() if v and k != "exchanges"}
        print(f"{name:30s} exchanges={hits['exchanges']:3d} {flag if flag else ''}", flush=True)
    return out


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from waypoint.session import local_session
    spark = local_session(8, 8)
    audit(spark, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
