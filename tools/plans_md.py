"""Write PLANS.md: exchanges per registered query and the booking-table plan.

Usage: python tools/plans_md.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

sys.path.insert(0, ".")


def main():
    from tools.plan_audit import audit
    from waypoint.operators import units as U
    from waypoint.plans.registry import model
    from waypoint.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 8, conf={"spark.sql.autoBroadcastJoinThreshold": "-1"})
    with contextlib.redirect_stdout(io.StringIO()):
        res = audit(spark, sf)
        m = model(spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            U.booking_units(m.running, m.customer_units, m.lob_wide_year, m.p, m.hot).explain()
    plan = buf.getvalue()
    plan = re.sub(r"#\d+L?", "", plan)
    plan = re.sub(r"file:/\S+/scratch/([a-z-]+)-[0-9a-f]{12}", r"<scratch>/\1", plan)
    plan = re.sub(r", \[plan_id=\d+\]", "", plan)
    out = ["# PLANS", "",
           "Generated by `tools/plans_md.py` at sf0.01 with automatic broadcasts off (so the",
           "exchanges a large input would get are visible). `exchanges` counts `Exchange` nodes",
           "in the physical plan (AQE may remove some at runtime); `single` counts single-partition",
           "exchanges: final merges of global aggregates (one row per partition), and in",
           "`growth_multipliers` the ordered window over the histogram (one row per distinct",
           "unit value). No query has a cartesian / nested-loop join or Python evaluation.", "",
           "| query | exchanges | single |", "|---|---|---|"]
    for name, h in res.items():
        out.append(f"| `{name}` | {h['exchanges']} | {h['single_partition']} |")
    out += ["", "## Booking table (before it is written)", "",
            "Inputs are the stage tables written earlier (the rolled-up lines, the segments); the",
            "running totals come from a checkpointed range partitioning (`Scan ExistingRDD`).",
            "", "```", plan.strip(), "```", ""]
    print("\n".join(out))


if __name__ == "__main__":
    main()
