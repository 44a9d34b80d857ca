"""The two simulator inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from waypoint.functions.kernel import round_half_even, strict_sum
from waypoint.params import ModelParams

VIEW_COLS = ("units_earned_prev_year", "units_earned_current_year",
             "units_earned_start_of_booking")
UNIT_TYPES = ("trip_elements", "bookings")


def output_order(levels: tuple[str, ...] = ()) -> list[Column]:
    """Row order of the output files: trip elements before bookings, segments in the
    order of ``levels`` (then by name), then the unit counts."""
    rank = lambda c, names: F.coalesce(
        F.array_position(F.array(*[F.lit(x) for x in names]).cast("array<string>"), F.col(c)), F.lit(0))
    last = F.when(rank("segment", levels) == 0, len(levels) + 1).otherwise(rank("segment", levels))
    return [rank("unit_type", UNIT_TYPES), last, F.col("segment"), *[F.col(c) for c in VIEW_COLS]]


def _views():
    return F.array(*[
        F.struct(F.col(f"{t}_prev_year").alias(VIEW_COLS[0]),
                 F.col(f"{t}_current_year").alias(VIEW_COLS[1]),
                 F.col(f"{t}_start_of_booking").alias(VIEW_COLS[2]),
                 F.lit(t).alias("unit_type"))
        for t in UNIT_TYPES])


def unit_views(booking_units: DataFrame) -> DataFrame:
    """Each booking twice: once in trip elements, once in bookings (a 2-row unpivot)."""
    base = [c for c in booking_units.columns]
    return booking_units.select(*base, F.inline(_views()))


def _round_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[
        round_half_even(F.col(f.name).cast("double")).alias(f.name)
        if isinstance(f.dataType, NumericType) else F.col(f.name)
        for f in df.schema.fields])


def bookings_for_simulator(views: DataFrame, p: ModelParams) -> DataFrame:
    """Bookings by segment and units earned (prev year, current year, start of booking)."""
    keys = ["segment", *VIEW_COLS]
    out = (views.groupBy("unit_type", *keys)
                .agg((strict_sum("bookings") / F.lit(p.extract_fraction)).alias("bookings")))
    return _round_numeric(out.select(*keys, "unit_type", "bookings"))


def members_for_simulator(booking_units: DataFrame, p: ModelParams) -> DataFrame:
    """Members, value, bookings, units, packages and LOB totals per segment and units earned.

    Collapsed to one row per customer first: a customer has one (prev, current)
    pair per unit type, so a plain count gives the distinct member count.
    """
    lob_cols = [c for c in booking_units.columns if c.startswith("lob_")]
    measures = ["gbvlc", "bookings", "trip_elements"]
    per_cust = (booking_units
                .groupBy("ccid", "segment",
                         *[f"{t}_{s}" for t in UNIT_TYPES for s in ("prev_year", "current_year")])
                .agg(*[strict_sum(m).alias(m) for m in measures],
                     F.sum(F.col("is_package").cast("int")).alias("packages"),
                     *[strict_sum(c).alias(c) for c in lob_cols]))
    views = F.array(*[
        F.struct(F.col(f"{t}_prev_year").alias(VIEW_COLS[0]),
                 F.col(f"{t}_current_year").alias(VIEW_COLS[1]),
                 F.lit(t).alias("unit_type"))
        for t in UNIT_TYPES])
    long = per_cust.select("segment", *measures, "packages", *lob_cols, F.inline(views))
    frac = F.lit(p.extract_fraction)
    keys = ["segment", VIEW_COLS[0], VIEW_COLS[1]]
    out = long.groupBy("unit_type", *keys).agg(
        (F.count(F.lit(1)) / frac).alias("num_members"),
        *[(strict_sum(m).cast("double") / frac).alias(m) for m in measures],
        (F.sum("packages") / frac).alias("packages"),
        *[(strict_sum(c).cast("double") / frac).alias(c) for c in lob_cols])
    return _round_numeric(out.select(*keys, "unit_type", "num_members", *measures,
                                     "packages", *lob_cols))
