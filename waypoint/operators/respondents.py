"""Respondent-level feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypoint.functions.kernel import filled_sum, strict_sum
from waypoint.operators.lines import year_slice
from waypoint.params import ModelParams
from waypoint.session import materialize
from waypoint.sources.fixtures import FLAG_SUM_COLUMNS, NATURAL_KEY

# The per-LOB metrics of the respondent table (output name, source column).
LOB_METRICS = (
    ("num_bookings", None),
    ("unit_count", "unit_count"),
    ("gross_booking_amount_usd", "gbv"),
    ("loyalty_amount_net_burned_usd", "loyalty_amount_net_burned_usd"),
    ("loyalty_amount_net_earned_usd", "loyalty_amount_net_earned_usd"),
)


def respondent_rollup(tx: DataFrame, columns=FLAG_SUM_COLUMNS) -> DataFrame:
    """(customer, LOB, booking) sums of the metrics and flags, missing if any input is: the one pass over
    the lines, from which LOB domain, metrics and flag sums are finished. Written once."""
    sources = [src for _, src in LOB_METRICS if src]
    missing = [c for c in columns if c not in tx.columns]
    if missing:
        raise ValueError(f"flag columns not in the transaction table: {', '.join(missing)}")
    return materialize(tx.groupBy("ccid", "lob", "booking_code").agg(
        *[strict_sum(c).alias(c) for c in dict.fromkeys([*sources, *columns])]), "respondent-rollup")


def lob_levels(rolled: DataFrame, limit: int = ModelParams.max_lobs) -> list[str | None]:
    """The LOB domain present in the data (bounded, like a pivot's value scan).

    ``limit`` (the ``max_lobs`` parameter) only stops a run whose table would be too wide."""
    rows = rolled.select("lob").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} lines of business; cannot pivot them wide")
    return sorted((r[0] for r in rows), key=lambda v: (v is None, v or ""))


def _metric_columns(levels: list[str | None]) -> list[F.Column]:
    """Five metrics a LOB as ``{metric}_lob_{lob}``; absent cells 0, a null LOB is the level ``NA``.
    A row of the roll-up is one distinct booking code (a missing code is one value)."""
    out = []
    for metric, src in LOB_METRICS:
        for lv in levels:
            cond = F.col("lob").isNull() if lv is None else (F.col("lob") == lv)
            name = f"{metric}_lob_{'NA' if lv is None else lv}"
            out.append((F.count(F.when(cond, F.lit(1))).cast("long") if src is None else filled_sum(src, cond)).alias(name))
    return out


def lob_metrics_wide(rolled: DataFrame, levels: list[str | None]) -> DataFrame:
    """Per customer: the metrics of every LOB, wide, from the roll-up."""
    return rolled.groupBy("ccid").agg(*_metric_columns(levels))


def flag_sums(rolled: DataFrame, columns=FLAG_SUM_COLUMNS) -> DataFrame:
    """Per customer: sums of the flag / quantity columns, null if any input is null, from the roll-up."""
    return rolled.groupBy("ccid").agg(*[strict_sum(c).alias(c) for c in columns])


def survey_features(cid_to_ccid: DataFrame, ccids: DataFrame, tx: DataFrame,
                    year: int, levels: list[str | None] | None = None,
                    columns=FLAG_SUM_COLUMNS) -> DataFrame:
    """One row per surveyed id: natural key, LOB metrics and flag sums, missing -> 0.

    Lines are read once, by the roll-up; metrics and sums are one grouping of it."""
    rolled = respondent_rollup(year_slice(tx, year), columns)
    levels = lob_levels(rolled) if levels is None else levels
    both = rolled.groupBy("ccid").agg(*_metric_columns(levels), *[strict_sum(c).alias(c) for c in columns])
    j = cid_to_ccid.join(ccids, "ccid").join(both, "ccid", "left")
    keep = {"ccid", "cid", NATURAL_KEY}
    j = j.select(*[F.col(c) if c in keep else F.coalesce(F.col(c), F.lit(0)).alias(c)
                   for c in j.columns])
    rest = [c for c in j.columns if c not in keep]
    return j.select("cid", NATURAL_KEY, *rest)
