"""Stage reconciliation: value, bookings and units at each pipeline stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypoint.functions.kernel import n_distinct_na, strict_sum
from waypoint.operators.joins import lookup_join
from waypoint.params import ModelParams
from waypoint.sources.cache import by_part

# Fixed value: the metric names a stage value's name starts with.
METRIC_PATTERN = "(gbvlc)|(bookings)|(trip_elements)"


def _row(df: DataFrame, stage: str, exprs: dict[str, F.Column]) -> DataFrame:
    """One aggregate row per stage, as (type, value) pairs."""
    agg = df.agg(*[e.cast("double").alias(m) for m, e in exprs.items()])
    pairs = F.array(*[F.struct(F.lit(f"{m}_{stage}").alias("type"),
                               F.col(m).alias("value")) for m in exprs])
    return agg.select(F.inline(pairs))


def _parts(cond, gbv: str, units: str) -> dict:
    """What a strict total needs of the rows that meet ``cond``: their number, and numbers and sums of values."""
    out = {"n": F.count_if(cond)}
    for name, c in (("gbvlc", gbv), ("trip_elements", units)):
        v = F.when(cond, F.col(c))
        out |= {f"n_{name}": F.count(v), name: F.sum(v)}
    return out


def raw_metrics(p: ModelParams) -> dict:
    """Observed on the line roll-up: its rows with units in the analysis year."""
    return _parts((F.col("use_year") == p.analysis_year) & (F.col("n_unit") > 0), "gbvlc", "trip_elements")


def line_metrics(p: ModelParams) -> dict:
    """Observed on the enriched lines of the analysis year."""
    return _parts(F.year("begin_use_date") == p.analysis_year, "gbvlc", "trip_elements")


def booking_metrics() -> dict:
    """Observed on the booking table."""
    return _parts(F.lit(True), "gbvlc", "trip_elements") | {"bookings": F.sum("bookings"), "n_bookings": F.count("bookings")}


def strict_total(found: list[dict], name: str):
    """Total of a metric over parts, as a column; null if a row had none."""
    if sum(f["n"] for f in found) != sum(f[f"n_{name}"] for f in found):
        return F.lit(None).cast("double")
    values = [f[name] for f in found if f[name] is not None]
    return F.lit(sum(values)).cast("double") if values else F.lit(None).cast("double")


def stage_values(m) -> DataFrame:
    """(type, value) rows such as ``gbvlc_raw_members`` of a model ``m``; every value scaled.

    Value and unit totals are observed while the line roll-up, the enriched
    lines and the booking table are written; counts of booking codes come from
    tables with a row a booking. No line is read again.
    """
    p, frac, n_types = m.p, F.lit(m.p.extract_fraction), 2.0
    year = (F.col("use_year") == p.analysis_year) & (F.col("n_unit") > 0)
    members = m.members.distinct()
    of_members = by_part(m.line_parts, lambda x, hot: lookup_join(x.where(year), members, "ccid", "left_semi", hot=hot),
                         m.hot)
    booked = m.codes.agg(F.count_if("in_year").alias("n"))
    in_tx = m.by_lob.where(F.col("use_year") == p.analysis_year).agg(n_distinct_na("booking_code").alias("n"))
    m.enriched, m.booking_units  # noqa: B018  written, so observed
    got = {k: o.get for k, o in m.observed.items()}
    raw = [v for k, v in got.items() if k.startswith("raw")]
    total = lambda found, name: strict_total(found, name) / frac
    one = lambda table, exprs, stage: _row(table, stage, exprs)
    any_ = lambda e: F.max(e)  # noqa: E731  a constant, or the one row's count
    unit = got["unit_calculation"]
    parts = [
        one(booked, {"gbvlc": any_(total(raw, "gbvlc")), "bookings": any_(F.col("n")) / frac,
                     "trip_elements": any_(total(raw, "trip_elements"))}, "raw"),
        one(of_members, {"gbvlc": strict_sum("gbvlc").cast("double") / frac, "bookings": n_distinct_na("booking_code") / frac,
                         "trip_elements": strict_sum("trip_elements") / frac}, "raw_members"),
        one(in_tx, {"gbvlc": any_(total([got["tx"]], "gbvlc")), "bookings": any_(F.col("n")) / frac,
                    "trip_elements": any_(total([got["tx"]], "trip_elements"))}, "tx"),
        one(m.customer_units, {"bookings": F.sum("bookings_current_year") / frac,
                               "trip_elements": F.sum("trip_elements_current_year") / frac}, "current_year"),
        one(booked, {c: any_(total([unit], c)) for c in ("gbvlc", "bookings", "trip_elements")}, "unit_calculation"),
        one(m.bookings_out, {"bookings": F.sum("bookings") / n_types}, "book_for_sim"),
        one(m.members_out, {"gbvlc": F.sum("gbvlc") / n_types, "bookings": F.sum("bookings") / n_types,
                            "trip_elements": F.sum("trip_elements") / n_types}, "mem_for_sim"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def stage_reconciliation(values: DataFrame) -> DataFrame:
    """Reshape (type, value) to one row per stage with a column per metric."""
    metric = F.regexp_extract("type", METRIC_PATTERN, 0)
    stage = F.regexp_replace("type", f"^({METRIC_PATTERN})_", "")
    long = values.select(stage.alias("stage"), metric.alias("metric"), "value")
    return long.groupBy("stage").agg(*[
        F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
        for m in ("gbvlc", "bookings", "trip_elements")])
