"""Recorded vs calculated loyalty tier analytics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waypoint.functions.kernel import pmax_na, share_of_total, strict_min, strict_sum
from waypoint.functions.tiers import calculated_tier_code, int_to_tier, named_tier
from waypoint.operators.joins import lookup_join
from waypoint.operators.lines import eligible, year_slice
from waypoint.params import ModelParams


def recorded_tier_distribution(tx: DataFrame, member_ids: DataFrame, p: ModelParams,
                               hot: tuple = ()) -> DataFrame:
    """Share of bookings per recorded tier (tier 0 dropped), scaled to the population."""
    x = lookup_join(eligible(year_slice(tx, p.analysis_year), p).where(F.col("unit_count") > 0),
                    member_ids, "ccid", "left_semi", hot=hot, spread_copies=True)
    counts = (x.select("booking_code", "loyalty_tier").distinct()
               .groupBy("loyalty_tier").agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("loyalty_tier") > 0))
    # the share of scaled counts equals the share of the (exact) counts
    return counts.select("loyalty_tier",
                         (F.col("n") / F.lit(p.extract_fraction)).alias("num_bookings"),
                         share_of_total(counts, "n").alias("prct_bookings"))


def booking_dims(enriched: DataFrame, codes: DataFrame | None = None, hot_codes: tuple = ()) -> DataFrame:
    """Per booking: earliest booking date and lowest recorded tier (null-propagating).

    ``codes``: only these booking codes, whose lines of all years are kept before they are grouped."""
    if codes is not None:
        enriched = lookup_join(enriched.select("booking_code", "booking_date_pst", "loyalty_tier", "ccid"),
                               codes.select("booking_code").distinct(), "booking_code", "left_semi",
                               hot=hot_codes, null_safe=True)
    return enriched.groupBy("booking_code").agg(
        strict_min("booking_date_pst").alias("booking_date_pst"),
        strict_min("loyalty_tier").alias("loyalty_tier"))


def tier_compare(booking_units: DataFrame, enriched: DataFrame, p: ModelParams,
                 hot_codes: tuple = ()) -> DataFrame:
    """Calculated tier (from units before the booking / last year) next to the recorded one."""
    first_two = F.when(F.month("begin_use_date") <= 2, F.lit("Y")).otherwise(F.lit("N"))
    base = pmax_na("trip_elements_start_of_booking", "trip_elements_prev_year")
    for_tier = F.when(first_two == "Y", pmax_na(F.col("trip_elements_prev_2_year"), base)) \
                .otherwise(base)
    bu = (booking_units.withColumn("trip_elements_for_tier", for_tier)
          .withColumn("calculated_tier",
                      calculated_tier_code("trip_elements_for_tier", p.tier_thresholds)))
    # the lookup of a shared booking code is spread by customer and date
    j = lookup_join(bu, booking_dims(enriched, booking_units, hot_codes), "booking_code", "inner", hot=hot_codes, null_safe=True)
    return j.select("ccid", "booking_date_pst", "begin_use_date",
                    "trip_elements_start_of_booking", "trip_elements_prev_year",
                    "trip_elements_prev_2_year", "trip_elements", "booking_code",
                    "trip_elements_for_tier",
                    int_to_tier("calculated_tier").alias("calculated_tier"),
                    int_to_tier("loyalty_tier").alias("loyalty_tier"))


def tier_confusion(compare: DataFrame, by_month: bool = False) -> DataFrame:
    keys = ["loyalty_tier", "calculated_tier"]
    if by_month:
        compare = compare.withColumn("begin_month", F.date_format("begin_use_date", "MMM"))
        keys.append("begin_month")
    return compare.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def tier_mismatch_rows(compare: DataFrame, recorded: str = "Silver",
                       calculated: str = "Blue", month: int = 12) -> DataFrame:
    return compare.where((F.col("loyalty_tier") == recorded)
                         & (F.col("calculated_tier") == calculated)
                         & (F.month("begin_use_date") == month))


def customer_history(enriched: DataFrame, ccid) -> DataFrame:
    """All qualifying lines of one customer in use-date order, missing dates last."""
    return (enriched.where(F.col("ccid") == ccid)
            .orderBy(F.col("begin_use_date").asc_nulls_last(), F.col("booking_code").asc_nulls_last())
            .select("booking_code", "begin_use_date", "trip_elements", "lob", "loyalty_tier"))


def with_named_tier(booking_units: DataFrame, p: ModelParams) -> DataFrame:
    return booking_units.withColumn(
        "tier", named_tier("trip_elements_start_of_booking", "trip_elements_prev_year",
                           p.tier_thresholds))


def calculated_tier_totals(booking_units: DataFrame, p: ModelParams) -> DataFrame:
    frac = F.lit(p.extract_fraction)
    return (with_named_tier(booking_units, p).groupBy("tier")
            .agg((strict_sum("gbvlc").cast("double") / frac).alias("gbvlc"),
                 (strict_sum("bookings") / frac).alias("bookings")))


def recorded_tier_value(enriched: DataFrame, p: ModelParams, year: int | None = None) -> DataFrame:
    y = p.analysis_year if year is None else year
    return (year_slice(enriched, y).groupBy("loyalty_tier")
            .agg((strict_sum("gbvlc").cast("double") / F.lit(p.extract_fraction)).alias("gbvlc")))


def recorded_tier_counts(enriched: DataFrame, year: int) -> DataFrame:
    return (year_slice(enriched, year).groupBy("loyalty_tier")
            .agg(F.count(F.lit(1)).alias("n")))


def monthly_tier_mix(enriched: DataFrame, before: dt.date) -> DataFrame:
    """Recorded-tier mix per use month, with the share within the month."""
    counts = (enriched.where(F.col("begin_use_date") < F.lit(before))
              .groupBy(F.trunc("begin_use_date", "month").alias("begin_use_date"),
                       "loyalty_tier")
              .agg(F.count(F.lit(1)).alias("n")))
    # at most (#tiers) rows per month in each window partition
    return counts.withColumn(
        "p", F.col("n") / F.sum("n").over(Window.partitionBy("begin_use_date")))


def daily_bookings(booking_units: DataFrame) -> DataFrame:
    return booking_units.groupBy("begin_use_date").agg(F.count(F.lit(1)).alias("n"))


def monthly_calculated_tier(booking_units: DataFrame, p: ModelParams) -> DataFrame:
    return (with_named_tier(booking_units, p)
            .groupBy("tier", F.trunc("begin_use_date", "month").alias("begin_use_date"))
            .agg(F.count(F.lit(1)).alias("n")))


def calculated_tier_counts(booking_units: DataFrame, p: ModelParams) -> DataFrame:
    return with_named_tier(booking_units, p).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
