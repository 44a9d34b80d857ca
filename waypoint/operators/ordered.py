"""Order-dependent operators that must not funnel a hot key into one task.

Both operators range-partition on the full ordering, so the sampled range
bounds split even a key that holds a large share of all rows over several
partitions. Work per partition is then local; what crosses partitions is a
table of at most two rows per partition (its first and last key), which is
the only broadcast, and its size is bounded by the partition count.

The range-partitioned data, with its partition number as a column, is written
as Parquet into the shared checkpoint folder before it is read twice, so both
reads see the same partition numbers even if an executor is lost and a stage
is recomputed (and the copy is columnar and compressed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypoint.session import materialize

_PID = "__pid"


def _range(df: DataFrame, n: int | None, *cols) -> DataFrame:
    """Range exchange. Without an explicit count it uses the session's shuffle
    partitions and AQE may merge adjacent ranges (order is kept); the partition
    id is read after the exchange, so it always names the final partition."""
    return df.repartitionByRange(n, *cols) if n else df.repartitionByRange(*cols)


def dense_ids(keys: DataFrame, key: str, out: str = "ccid",
              num_partitions: int | None = None) -> DataFrame:
    """Number the distinct values of ``key`` 1..n in ascending order, nulls first.

    Equals ``row_number() OVER (ORDER BY key NULLS FIRST)`` over distinct keys,
    without the single-partition window that expression implies.
    """
    order = F.col(key).asc_nulls_first()
    ranged = (_range(keys.select(key).distinct(), num_partitions, order)
              .sortWithinPartitions(order)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn("__local", F.monotonically_increasing_id()
                          - F.shiftleft(F.col(_PID).cast("long"), 33)))
    ranged = materialize(ranged, "ranged-keys")
    sizes = ranged.groupBy(_PID).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(
        _PID,
        F.coalesce(F.sum("__n").over(Window.orderBy(_PID).rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    # offsets has one row per partition: the broadcast is bounded by the partition count
    return (ranged.join(F.broadcast(offsets), _PID)
            .select(F.col(key), (F.col("__off") + F.col("__local") + 1).alias(out)))


def exclusive_running_totals(df: DataFrame, key: str, order: list[str],
                             sums: dict[str, str], count_out: str | None = None,
                             num_partitions: int | None = None) -> DataFrame:
    """Per row: totals of earlier rows of the same ``key`` in ``order``.

    ``sums`` maps an output column to the column it accumulates; the output
    is 0 for a key's first row (a ROWS frame, so rows with equal order values
    do not merge). ``count_out`` names the number of earlier rows.
    The ordering must be unique within a key for the result to be defined;
    missing values come last.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    sort_cols = [F.col(key).asc(), *by]
    ranged = _range(df, num_partitions, *sort_cols).withColumn(_PID, F.spark_partition_id())
    ranged = materialize(ranged, "ranged-rows")

    # 1. running totals inside each (partition, key) piece
    w = (Window.partitionBy(_PID, key).orderBy(*by)
         .rowsBetween(Window.unboundedPreceding, -1))
    local = ranged.select(
        "*",
        *[F.coalesce(F.sum(src).over(w), F.lit(0)).alias(f"__l_{o}")
          for o, src in sums.items()],
        (F.row_number().over(Window.partitionBy(_PID, key).orderBy(*by)) - 1)
        .alias("__l_n"))

    # 2. a key continues from earlier partitions only as their last key and
    #    as the first key of this one: gather those pieces (<= 2 per partition)
    edges = ranged.groupBy(_PID).agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))
    pieces = (ranged.join(F.broadcast(edges), _PID)
              .where((F.col(key) == F.col("__lo")) | (F.col(key) == F.col("__hi")))
              .groupBy(_PID, key)
              .agg(*[F.sum(src).alias(f"__p_{o}") for o, src in sums.items()],
                   F.count(F.lit(1)).alias("__p_n")))
    before = Window.partitionBy(key).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        _PID, key,
        *[F.coalesce(F.sum(f"__p_{o}").over(before), F.lit(0)).alias(f"__o_{o}")
          for o in sums],
        F.coalesce(F.sum("__p_n").over(before), F.lit(0)).alias("__o_n"))

    out = local.join(F.broadcast(offsets), [_PID, key], "left")
    cols: list[Column] = [F.col(c) for c in df.columns]
    for o in sums:
        cols.append((F.col(f"__l_{o}") + F.coalesce(F.col(f"__o_{o}"), F.lit(0))).alias(o))
    if count_out:
        cols.append((F.col("__l_n") + F.coalesce(F.col("__o_n"), F.lit(0))).alias(count_out))
    return out.select(*cols)
