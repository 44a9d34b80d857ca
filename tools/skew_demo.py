"""Skew demonstration on data derived from the given tables.

Case 1: a third of all lines moved onto one customer. Compares the largest task of
a plain shuffle join / per-customer window with the salted lookup join /
range-partitioned running totals. Case 2: the third is made of exact copies of
one line (a part loaded many times), read from files. Broadcasts, AQE skew
splitting and partition coalescing are off so the raw shuffle shape is visible.

Usage: python tools/skew_demo.py [sf_dir]
"""

from __future__ import annotations

import sys
import tempfile
import time

sys.path.insert(0, ".")

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from waypoint.operators.joins import hot_keys, lookup_join  # noqa: E402
from waypoint.operators.ordered import exclusive_running_totals  # noqa: E402
from waypoint.plans import context  # noqa: E402
from waypoint.session import local_session  # noqa: E402

RAW_SHUFFLES = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.localShuffleReader.enabled": "false",
    "spark.sql.adaptive.skewJoin.enabled": "false",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def largest_task(df) -> tuple[int, int]:
    """(rows in the largest output partition, all rows); one integer per partition."""
    sizes = df.rdd.glom().map(len).collect()
    return max(sizes), sum(sizes)


def report(name, df) -> None:
    t = time.time()
    mx, tot = largest_task(df)
    print(f"{name:27s} largest task {mx:7d} of {tot} rows ({time.time() - t:.1f}s)")


def main() -> None:
    spark = local_session(8, 32, conf=RAW_SHUFFLES)
    c = context.load(spark, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
    tx = c.data.tx.select("ccid", "booking_code", "begin_use_date", "unit_count")
    dim = c.data.ccids.select("ccid", F.lit("x").alias("segment"))
    moved = F.pmod(F.xxhash64("booking_code", "begin_use_date"), 3) == 0

    # case 1: a third of the lines moved onto customer 1
    skewed = tx.withColumn("ccid", F.when(moved, F.lit(1)).otherwise(F.col("ccid")))
    n = skewed.count()
    hot = hot_keys(skewed, "ccid")
    print("lines", n, "hot keys", len(hot))
    report("plain join", skewed.join(dim, "ccid"))
    report("salted join", lookup_join(skewed, dim, "ccid", "inner", hot=hot))
    bk = skewed.groupBy("ccid", "booking_code").agg(F.min("begin_use_date").alias("d"),
                                                    F.sum("unit_count").alias("te"))
    w = (Window.partitionBy("ccid").orderBy("d", "booking_code")
         .rowsBetween(Window.unboundedPreceding, -1))
    plain_w = bk.withColumn("before", F.coalesce(F.sum("te").over(w), F.lit(0.0)))
    ranged = exclusive_running_totals(bk, "ccid", ["d", "booking_code"], {"before": "te"})
    report("plain window", plain_w)
    report("range-partitioned", ranged)
    a = {(r.ccid, r.booking_code): r.before for r in plain_w.collect()}
    b = {(r.ccid, r.booking_code): r.before for r in ranged.collect()}
    print("running totals equal:", a == b)

    # case 2: the third is exact copies of one line, read from files
    one = (tx.limit(1).withColumn("ccid", F.lit(1).cast("long"))
           .select(*tx.columns, F.explode(F.sequence(F.lit(1), F.lit(n // 3))).alias("_c"))
           .drop("_c"))
    path = tempfile.mkdtemp(prefix="run-skew-", dir="/tmp") + "/dup"
    tx.where(~moved).unionByName(one).write.parquet(path)
    dup = spark.read.parquet(path)
    hot = hot_keys(dup, "ccid")
    report("copies, plain join", dup.join(dim, "ccid"))
    report("copies, salted by content", lookup_join(dup, dim, "ccid", "inner", hot=hot))
    report("copies, salted + position",
           lookup_join(dup, dim, "ccid", "inner", hot=hot, spread_copies=True))


if __name__ == "__main__":
    main()
