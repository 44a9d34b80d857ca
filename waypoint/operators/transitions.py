"""Year-over-year transitions and growth multipliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waypoint.functions.kernel import share_of_total
from waypoint.operators.units import booking_years, customer_booking_lobs, customer_units
from waypoint.params import ModelParams


def units_compare(tx: DataFrame, member_ids: DataFrame, p: ModelParams,
                  hot: tuple = ()) -> DataFrame:
    """Current- and previous-year units of members active this year (prev null if none).

    The transition analysis keeps members only (no segment) and the
    transition LOBs (air, lodging).
    """
    dim = member_ids.select("ccid").distinct()
    y = p.analysis_year
    by_lob = customer_booking_lobs(tx, dim, p, p.transition_lobs, hot=hot, years=(y - 1, y))
    cu = customer_units(booking_years(None, p, years_back=1, by_lob=by_lob), p)
    return cu.select("ccid", "trip_elements_current_year", "bookings_current_year",
                     "trip_elements_prev_year", "bookings_prev_year")


def unit_transitions(uc: DataFrame, p: ModelParams) -> DataFrame:
    """Count per (current, previous) bookings, share within previous, then 1..band."""
    counts = uc.groupBy("bookings_current_year", "bookings_prev_year").agg(
        F.count(F.lit(1)).alias("n"))
    # one window partition per previous-year count: at most band-many rows each
    shares = counts.withColumn(
        "p", F.col("n") / F.sum("n").over(Window.partitionBy("bookings_prev_year")))
    b = p.band_max
    return shares.where((F.col("bookings_prev_year") <= b) & (F.col("bookings_prev_year") > 0)
                        & (F.col("bookings_current_year") <= b)
                        & (F.col("bookings_current_year") > 0))


def growth_cohort(uc: DataFrame, p: ModelParams) -> DataFrame:
    """Members with one booking last year and 2..band this year."""
    return uc.where((F.col("bookings_prev_year") == 1) & (F.col("bookings_current_year") > 1)
                    & (F.col("bookings_current_year") <= p.band_max))


def distribution(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", share_of_total(counts, "n"))


def _bucket(rank, n, k) -> F.Column:
    """The reference's bucket of a 0-based rank, in its double arithmetic."""
    return F.floor((rank.cast("double") / n.cast("double")) * F.lit(float(k)))


def growth_multipliers(cohort: DataFrame, p: ModelParams,
                       col: str = "trip_elements_current_year") -> DataFrame:
    """Equal-size buckets by units; bucket mean over cohort mean.

    No global sort of the cohort: rows are histogrammed by value (values of
    equal rank are interchangeable), each value's rank range
    [start, start + count) is split over the bucket edges, and bucket means are
    weighted by the overlaps. The only window without a partition runs over
    the histogram, whose size is the number of distinct unit values; it also
    carries the cohort size and total, so no second pass is needed.
    """
    k = p.num_buckets
    hist = cohort.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    everything = Window.partitionBy()
    ranked = hist.select(
        "v", "c",
        F.coalesce(F.sum("c").over(Window.orderBy("v").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("c").over(everything).alias("n"),
        F.sum(F.col("v") * F.col("c")).over(everything).alias("s"))
    n = F.col("n")
    first_b = _bucket(F.col("start"), n, k)
    last_b = _bucket(F.col("start") + F.col("c") - 1, n, k)
    per = ranked.select("v", "start", "c", "n", "s",
                        F.explode(F.sequence(first_b, last_b)).alias("b"))

    def edge(j):
        # smallest rank whose bucket is >= j, adjusted for the double arithmetic
        c = F.ceil((j * n) / F.lit(k))
        return (F.when(j <= 0, F.lit(0))
                 .when(_bucket(c - 1, n, k) >= j, c - 1)
                 .when(_bucket(c, n, k) >= j, c)
                 .otherwise(c + 1))
    lo = F.greatest(F.col("start"), edge(F.col("b")))
    hi = F.least(F.col("start") + F.col("c"),
                 F.when(F.col("b") + 1 >= k, n).otherwise(edge(F.col("b") + 1)))
    # a value's rank range may span a bucket holding no rank at all (more buckets
    # than rows): such pieces have no overlap and no group in the reference
    w = per.withColumn("w", (hi - lo).cast("double")).where(F.col("w") > 0)
    means = w.groupBy("b").agg(
        (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("group_mean_trip_elements"),
        (F.max("s") / F.max("n")).alias("mean"))
    return means.select(
        (F.col("b").cast("double") / F.lit(float(k))).alias("percentile_group"),
        "group_mean_trip_elements",
        F.try_divide(F.col("group_mean_trip_elements"), F.col("mean")).alias("group_multiplier"))
