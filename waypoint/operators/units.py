"""Units earned per customer and per booking.

Qualifying lines are rolled up once, map-side combined, to
(customer, booking, segment, use year, LOB); the customer totals, the booking
roll-up and the LOB table all derive from that roll-up, so only booking-sized
data is exchanged afterwards and the running totals see bookings, not lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypoint.functions.kernel import filled_sum, strict_min, strict_sum, year_filter
from waypoint.operators.joins import lookup_join
from waypoint.operators.lines import eligible
from waypoint.operators.ordered import exclusive_running_totals
from waypoint.params import ModelParams

UNIT_COLS = ("trip_elements_start_of_booking", "trip_elements_current_year",
             "trip_elements_prev_year", "trip_elements_prev_2_year",
             "bookings", "bookings_start_of_booking", "bookings_current_year",
             "bookings_prev_year")
WIDE_METRICS = ("gbvlc", "bookings", "trip_elements")


def wide_columns(p: ModelParams) -> list[str]:
    ext = list(p.lobs) + [f"{l}_package" for l in p.lobs]
    return [f"lob_{m}_{e}" for m in WIDE_METRICS for e in ext]


def unit_lines(tx: DataFrame, p: ModelParams, lobs: tuple[str, ...] | None = None) -> DataFrame:
    """Eligible lines that earn units (all years, all customers), model column names."""
    return (eligible(tx, p, lobs).where(F.col("unit_count") > 0)
            .select(*(["use_year"] if "use_year" in tx.columns else []),
                    "ccid", "booking_code", "lob", "begin_use_date",
                    F.col("unit_count").alias("trip_elements"),
                    F.col("gbv").alias("gbvlc")))


def qualifying_lines(tx: DataFrame, cust_dim: DataFrame, p: ModelParams,
                     lobs: tuple[str, ...] | None = None, hot: tuple = ()) -> DataFrame:
    """Eligible lines with units of customers in ``cust_dim`` (all years), line level.

    Hot customers are salted with the row position (copies spread), so filter
    the lines before calling: later filters are not pushed below the join.
    """
    return lookup_join(unit_lines(tx, p, lobs), cust_dim, "ccid", "inner", hot=hot,
                       spread_copies=True)


def customer_booking_lobs(tx: DataFrame, cust_dim: DataFrame, p: ModelParams,
                          lobs: tuple[str, ...] | None = None, hot: tuple = (),
                          years: tuple[int, int] | None = None) -> DataFrame:
    """(customer, booking, [segment,] use year, LOB) roll-up of the customers in ``cust_dim``.

    The roll-up runs first (map-side combined, the one exchange of
    line-level rows); the customer dimension (one row per customer, so the
    join commutes with the roll-up) is joined to the rolled-up rows.
    """
    lines = unit_lines(tx, p, lobs)
    if years is not None:
        lines = lines.where(year_filter(lines, *years))
    rolled = booking_lob_years(lines)
    out = lookup_join(rolled, cust_dim, "ccid", "inner", hot=hot)
    keys = ["ccid", "booking_code"] + (["segment"] if "segment" in out.columns else [])
    return out.select(*keys, "use_year", "lob", "trip_elements", "gbvlc", "begin_use_date")


def active_customers(rollup: DataFrame, cust_dim: DataFrame, p: ModelParams) -> DataFrame:
    """Customers of ``cust_dim`` with units in the analysis year (J12); no exchange of a clustered roll-up."""
    ids = (rollup.where((F.col("use_year") == p.analysis_year) & (F.col("n_unit") > 0))
           .groupBy("ccid").agg(F.lit(1).alias("__one")).select("ccid"))
    return cust_dim.join(ids, "ccid", "left_semi")


def active_booking_lobs(rollup: DataFrame, active: DataFrame, hot: tuple = ()) -> DataFrame:
    """The line roll-up of active customers with their columns (segment), lines with units only.

    Customers that never count leave here, before anything is exchanged: the
    roll-up is clustered by customer, only the customers' side moves.
    """
    rows = rollup.where(F.col("n_unit") > 0)
    out = lookup_join(rows, active, "ccid", "inner", hot=hot)
    keys = ["ccid", "booking_code"] + (["segment"] if "segment" in out.columns else [])
    return out.select(*keys, "use_year", "lob", "trip_elements", "gbvlc", "begin_use_date")


def booking_lob_years(lines: DataFrame) -> DataFrame:
    """(customer, booking, segment, use year, LOB) roll-up of qualifying lines, all years.

    The one exchange of line-level data in the model; it combines map-side.
    The booking-year table and the LOB table are both derived from it.
    """
    keys = ["ccid", "booking_code"] + (["segment"] if "segment" in lines.columns else [])
    return (lines.groupBy(*keys, F.year("begin_use_date").alias("use_year"), "lob")
                 .agg(strict_sum("trip_elements").alias("trip_elements"),
                      strict_sum("gbvlc").alias("gbvlc"),
                      strict_min("begin_use_date").alias("begin_use_date")))


def booking_years(lines: DataFrame, p: ModelParams, years_back: int = 2,
                  by_lob: DataFrame | None = None) -> DataFrame:
    """(customer, booking, use year) roll-up over the analysis year and the years before."""
    y = p.analysis_year
    lo = y - years_back
    if by_lob is None:
        by_lob = booking_lob_years(lines.where(year_filter(lines, lo, y)))
    keys = ["ccid", "booking_code"] + (["segment"] if "segment" in by_lob.columns else [])
    return (by_lob.where(F.col("use_year").between(lo, y))
                  .groupBy(*keys, "use_year")
                  .agg(strict_sum("trip_elements").alias("trip_elements"),
                       strict_sum("gbvlc").alias("gbvlc"),
                       strict_min("begin_use_date").alias("begin_use_date"),
                       F.count(F.lit(1)).alias("n_lob")))


def customer_units(by: DataFrame, p: ModelParams) -> DataFrame:
    """Current-year units of active customers, with previous years' (A2 + A3 fused).

    A customer is active when it has a booking in the analysis year. Booking
    counts are counts of (customer, booking) groups, i.e. distinct booking
    codes with a missing code counted once. Previous-year values are null
    when the customer had no booking then (the left join of the reference).
    """
    y = p.analysis_year

    def yr(k):
        return F.col("use_year") == (y - k)

    def sum_if(k):
        return F.sum(F.when(yr(k), F.col("trip_elements")))

    def count_if(k):
        return F.count(F.when(yr(k), F.lit(1)))

    agg = by.groupBy("ccid").agg(
        sum_if(0).alias("trip_elements_current_year"),
        count_if(0).alias("bookings_current_year"),
        sum_if(1).alias("trip_elements_prev_year"),
        count_if(1).alias("bookings_prev_year"),
        sum_if(2).alias("trip_elements_prev_2_year"),
        count_if(2).alias("bookings_prev_2_year"))
    out = agg.where(F.col("bookings_current_year") > 0)
    for s in ("prev_year", "prev_2_year"):
        has = F.col(f"bookings_{s}") > 0
        out = (out.withColumn(f"trip_elements_{s}", F.when(has, F.col(f"trip_elements_{s}")))
                  .withColumn(f"bookings_{s}", F.when(has, F.col(f"bookings_{s}"))))
    return out.drop("bookings_prev_2_year")


def booking_rollup(by: DataFrame, p: ModelParams) -> DataFrame:
    """One row per (customer, booking, segment) used in the analysis year (A5)."""
    return (by.where(F.col("use_year") == p.analysis_year)
              .select("ccid", "booking_code", "segment", "trip_elements",
                      F.lit(1.0).alias("bookings"), "begin_use_date",
                      (F.col("n_lob") > 1).alias("is_package"), "gbvlc"))


def running_units(rollup: DataFrame) -> DataFrame:
    """Units and bookings earned before each booking in the year.

    Order: use date, then booking code and segment (the reference's stable
    sort after its grouped roll-up). Skew-safe: see ``exclusive_running_totals``.
    """
    out = exclusive_running_totals(
        rollup, "ccid", ["begin_use_date", "booking_code", "segment"],
        {"trip_elements_start_of_booking": "trip_elements"},
        count_out="bookings_start_of_booking")
    return out.withColumn("bookings_start_of_booking",
                          F.col("bookings_start_of_booking").cast("double"))


def booking_lob_wide(by_lob: DataFrame, active: DataFrame | None, packages: DataFrame,
                     p: ModelParams, hot: tuple = (),
                     only_codes: DataFrame | None = None, hot_codes: tuple = ()) -> DataFrame:
    """Per booking: value, presence and units for the 6 extended LOBs (A4).

    Over all years of active customers' qualifying lines, from the
    (customer, booking, year, LOB) roll-up. One conditional aggregation per
    LOB replaces the reference's three pivots and re-aggregation; the package
    flag (constant per booking) then routes each LOB total to its standalone
    or ``_package`` column. Always 18 columns.

    ``active`` may be None if ``by_lob`` holds active customers only.
    ``only_codes`` limits the table to those booking codes (the model needs
    only the analysis year's), before the aggregation.
    """
    act = by_lob if active is None else lookup_join(by_lob, active.select("ccid"), "ccid", "left_semi", hot=hot)
    if only_codes is not None:
        codes = only_codes.select("booking_code").distinct()
        act = lookup_join(act, codes, "booking_code", "left_semi", hot=hot_codes, null_safe=True)
    aggs = []
    for l in p.lobs:
        is_l = F.col("lob") == l
        aggs += [filled_sum("gbvlc", is_l).alias(f"g_{l}"),
                 F.max(is_l.cast("double")).alias(f"b_{l}"),
                 filled_sum("trip_elements", is_l).alias(f"t_{l}")]
    per_booking = act.groupBy("booking_code").agg(*aggs)
    pk = packages.select(F.col("booking_code").alias("__bc"), "is_package")
    j = (per_booking.join(pk, per_booking["booking_code"].eqNullSafe(pk["__bc"]), "left")
                    .withColumn("__pkg", F.coalesce("is_package", F.lit(False))))
    cols = [F.col("booking_code")]
    for m, short in (("gbvlc", "g"), ("bookings", "b"), ("trip_elements", "t")):
        for pkg_side in (False, True):
            for l in p.lobs:
                src = F.col(f"{short}_{l}")
                zero = F.lit(0).cast(j.schema[f"{short}_{l}"].dataType)
                v = F.when(F.col("__pkg") == F.lit(pkg_side), src).otherwise(zero)
                name = f"lob_{m}_{l}_package" if pkg_side else f"lob_{m}_{l}"
                cols.append(v.alias(name))
    return j.select(*cols)


def booking_units(running: DataFrame, cust_units: DataFrame, wide: DataFrame,
                  p: ModelParams, hot: tuple = (), hot_codes: tuple = ()) -> DataFrame:
    """The booking table of the model: one row per booking in the analysis year.

    Joins customer totals (inner) and the LOB table (left), fills missing unit
    columns with 0 and caps them at ``unit_cap``. ``trip_elements`` itself and
    the ``lob_*`` columns are not capped.
    """
    cu = cust_units.withColumns({
        c: F.col(c).cast("double") for c in cust_units.columns if c != "ccid"})
    # rows of a booking code many customers share (a missing one, say) spread by customer
    j = lookup_join(lookup_join(running, cu, "ccid", "inner", hot=hot), wide, "booking_code",
                    "left", hot=hot_codes, null_safe=True)
    cap = float(p.unit_cap)
    fixed = {c: F.least(F.coalesce(F.col(c), F.lit(0.0)), F.lit(cap)) for c in UNIT_COLS}
    j = j.withColumns(fixed)
    head = ["ccid", "booking_code", "segment", "trip_elements", "bookings",
            "begin_use_date", "is_package", "gbvlc",
            "trip_elements_start_of_booking", "bookings_start_of_booking",
            "trip_elements_current_year", "bookings_current_year",
            "trip_elements_prev_year", "bookings_prev_year", "trip_elements_prev_2_year"]
    return j.select(*head, *wide_columns(p))


def shared_booking_codes(booking_units: DataFrame) -> DataFrame:
    """How many of the year's booking codes are used by more than one customer.

    Those codes carry the combined ``lob_*`` values of all their customers
    (the LOB table is keyed by booking code alone), as in the reference.
    One row: codes, shared codes, most customers on one code.
    """
    per_code = booking_units.groupBy("booking_code").agg(F.count(F.lit(1)).alias("n"))
    return per_code.agg(F.count(F.lit(1)).alias("n_booking_codes"),
                        F.count(F.when(F.col("n") > 1, F.lit(1))).alias("n_shared_codes"),
                        F.coalesce(F.max("n"), F.lit(0)).cast("long")
                        .alias("max_customers_per_code"))
