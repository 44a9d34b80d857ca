"""Line-level filters and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypoint.functions.kernel import null_tokens, text_year, year_filter
from waypoint.operators.joins import lookup_join
from waypoint.params import ModelParams
from waypoint.sources.cache import by_part


def year_slice(tx: DataFrame, year: int, col: str = "begin_use_date") -> DataFrame:
    """Lines used in ``year`` (a date range, so the scan can prune)."""
    return tx.where(year_filter(tx, year, col=col))


def eligible(tx: DataFrame, p: ModelParams, lobs: tuple[str, ...] | None = None) -> DataFrame:
    """Lines of the modelled brand and lines of business."""
    lobs = p.lobs if lobs is None else lobs
    if not p.brand:
        raise ValueError("ModelParams.brand is not set")
    return tx.where(F.col("lob").isNotNull() & (F.col("eg_brand_code") == p.brand)
                    & F.col("lob").isin(*lobs))


def members(cust: DataFrame, p: ModelParams,
            join_col: str = "first_ever_bex_ok_join_date") -> DataFrame:
    """Customers with a join date in or before the analysis year (one row per customer row)."""
    jd = null_tokens(F.col(join_col), ("null",))
    return (cust.select("ccid", jd.alias("join_date"))
                .where(F.col("join_date").isNotNull()
                       & (text_year("join_date") <= p.analysis_year))
                .select("ccid"))


def package_flags(tx: DataFrame, p: ModelParams) -> DataFrame:
    """Bookings with more than one eligible line of business (A1).

    Counted over all eligible lines, every year and customer, before the
    unit and member filters. Presence flags per LOB replace a distinct count,
    so the aggregate needs no Expand and combines map-side.
    """
    lines = eligible(tx, p)
    present = [F.max((F.col("lob") == l).cast("int")) for l in p.lobs]
    n = present[0]
    for x in present[1:]:
        n = n + x
    return (lines.groupBy("booking_code").agg(n.alias("n"))
                 .select("booking_code", "n", (F.col("n") > 1).alias("is_package")))


def line_rollup(tx: DataFrame, p: ModelParams) -> DataFrame:
    """Eligible lines by (customer, booking, use year, LOB): the one pass over all years' lines.

    ``n_lines`` counts them; units, value and first use are those of the ``n_unit`` lines that earn
    units, missing if any input is. On lines clustered by customer it needs no exchange.
    """
    unit = F.col("unit_count") > 0
    strict = lambda agg, c: F.when(F.count(F.when(unit, F.col(c))) == F.count_if(unit), agg(F.when(unit, F.col(c))))
    return (eligible(tx, p).groupBy("ccid", "booking_code", F.year("begin_use_date").alias("use_year"), "lob")
            .agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(unit).alias("n_unit"),
                 strict(F.sum, "unit_count").alias("trip_elements"), strict(F.sum, "gbv").alias("gbvlc"),
                 strict(F.min, "begin_use_date").alias("begin_use_date")))


def code_totals(rollup: DataFrame, p: ModelParams) -> DataFrame:
    """Per booking code, of all customers and years: LOBs (A1), lines, and whether the analysis year has units."""
    n = sum((F.max((F.col("lob") == l).cast("int")) for l in p.lobs[1:]), F.max((F.col("lob") == p.lobs[0]).cast("int")))
    raw = (F.col("use_year") == p.analysis_year) & (F.col("n_unit") > 0)
    return (rollup.groupBy("booking_code").agg(n.alias("n"), F.sum("n_lines").alias("n_lines"),
                                               F.coalesce(F.max(raw), F.lit(False)).alias("in_year"))
            .select("booking_code", "n", (F.col("n") > 1).alias("is_package"), "n_lines", "in_year"))


def lob_ext(lob: str = "lob", pkg: str = "is_package"):
    """``lob`` plus ``_package`` for packaged bookings (6 levels)."""
    return F.concat(F.col(lob), F.when(F.col(pkg), F.lit("_package")).otherwise(F.lit("")))


#: What the model and the analyses read of the enriched lines (of more than 30 columns).
ENRICHED_COLUMNS = ("ccid", "booking_code", "lob", "lob_ext", "segment", "is_package",
                    "begin_use_date", "booking_date_pst", "loyalty_tier", "gbvlc", "trip_elements")


def enriched_lines(parts: tuple[DataFrame, ...], segments: DataFrame, packages: DataFrame,
                   member_ids: DataFrame, p: ModelParams, hot: tuple = (),
                   hot_codes: tuple = ()) -> DataFrame:
    """Qualifying lines with segment, package flag and extended LOB (``tx`` of the model).

    Filters run before the joins; segments and members are one customer
    dimension. Lines clustered by customer meet it where they are; the hot
    customers' part is salted. All are exchanged once on ``booking_code``.
    """
    cust_dim = segments.join(member_ids.distinct(), "ccid", "left_semi")
    with_dim = by_part(parts, lambda x, h: lookup_join(eligible(x, p).where(F.col("unit_count") > 0), cust_dim,
                                                       "ccid", "inner", hot=h, spread_copies=True), hot)
    out = (lookup_join(with_dim, packages.select("booking_code", "is_package"), "booking_code",
                       "left", hot=hot_codes, null_safe=True)
           .withColumn("is_package", F.coalesce("is_package", F.lit(False))))
    return (out.withColumn("lob_ext", lob_ext())
               .withColumnsRenamed({"gbv": "gbvlc", "unit_count": "trip_elements"}))
