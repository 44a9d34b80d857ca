"""The analyses around the model: tiers, transitions, growth, reconciliation, predicted segments.

Each is a function of the model job's lazy nodes, so that the registered
queries and the file-to-file job (``jobs.analyses_job``) are the same code.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypoint.operators import forest as RF
from waypoint.operators import lines as L
from waypoint.operators import reconcile as R
from waypoint.operators import sampling as SM
from waypoint.operators import tiers as T
from waypoint.operators import transitions as TR
from waypoint.plans.model import Model
from waypoint.sources.cache import by_part

ANALYSES: dict[str, Callable[[Model], DataFrame]] = {}


def analysis(fn: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
    ANALYSES[fn.__name__] = fn
    return fn


@analysis
def stage_reconciliation(m: Model) -> DataFrame:
    """Value, bookings and units at each stage."""
    return R.stage_reconciliation(m.stage_values)


# ---------------------------------------------------------------- tiers
@analysis
def recorded_tier_distribution(m: Model) -> DataFrame:
    """Share of bookings per recorded tier."""
    return T.recorded_tier_distribution(m.data.tx, m.members.distinct(), m.p, m.hot)


@analysis
def tier_compare(m: Model) -> DataFrame:
    """Calculated tier next to the recorded one."""
    return T.tier_compare(m.booking_units, m.enriched, m.p, m.hot_codes)  # dims of the year's booking codes only


@analysis
def tier_confusion(m: Model) -> DataFrame:
    """Recorded x calculated tier counts."""
    return T.tier_confusion(tier_compare(m))


@analysis
def tier_confusion_monthly(m: Model) -> DataFrame:
    """Recorded x calculated tier counts per use month."""
    return T.tier_confusion(tier_compare(m), by_month=True)


@analysis
def tier_mismatch_rows(m: Model) -> DataFrame:
    """bookings recorded Silver, calculated Blue, in December."""
    return T.tier_mismatch_rows(tier_compare(m))


@analysis
def calculated_tier_totals(m: Model) -> DataFrame:
    """Value and bookings per calculated tier."""
    return T.calculated_tier_totals(m.booking_units, m.p)


@analysis
def recorded_tier_value(m: Model) -> DataFrame:
    """Analysis-year value per recorded tier."""
    return T.recorded_tier_value(m.enriched, m.p)


@analysis
def recorded_tier_counts(m: Model) -> DataFrame:
    """Next-year line counts per recorded tier."""
    return T.recorded_tier_counts(m.enriched, m.p.analysis_year + 1)


@analysis
def monthly_tier_mix(m: Model) -> DataFrame:
    """Recorded-tier mix per month."""
    return T.monthly_tier_mix(m.enriched, dt.date(m.p.analysis_year + 1, 8, 1))


@analysis
def daily_bookings(m: Model) -> DataFrame:
    """Bookings per use date."""
    return T.daily_bookings(m.booking_units)


@analysis
def monthly_calculated_tier(m: Model) -> DataFrame:
    """Calculated-tier counts per month."""
    return T.monthly_calculated_tier(m.booking_units, m.p)


@analysis
def calculated_tier_counts(m: Model) -> DataFrame:
    """Calculated-tier counts."""
    return T.calculated_tier_counts(m.booking_units, m.p)


# ---------------------------------------------------------------- transitions
def units_compare(m: Model) -> DataFrame:
    return by_part(m.data.tx_parts, lambda x, hot: TR.units_compare(x, m.members, m.p, hot), m.hot)


def growth_cohort(m: Model) -> DataFrame:
    return TR.growth_cohort(units_compare(m), m.p)


@analysis
def unit_transitions(m: Model) -> DataFrame:
    """Previous -> current booking transitions with shares."""
    return TR.unit_transitions(units_compare(m), m.p)


@analysis
def survey_unit_transitions(m: Model) -> DataFrame:
    """The transition table on the survey sample instead of the full extract."""
    s, members = m.survey, L.members(m.survey.cust, m.p)
    return TR.unit_transitions(
        by_part(s.tx_parts, lambda x, hot: TR.units_compare(x, members, m.p, hot), s.hot_ccids), m.p)


@analysis
def growth_bookings_dist(m: Model) -> DataFrame:
    """Current bookings distribution in the cohort."""
    return TR.distribution(growth_cohort(m), "bookings_current_year")


@analysis
def growth_units_dist(m: Model) -> DataFrame:
    """Current units distribution in the cohort."""
    return TR.distribution(growth_cohort(m), "trip_elements_current_year")


@analysis
def growth_multipliers(m: Model) -> DataFrame:
    """Bucket means over the cohort mean."""
    return TR.growth_multipliers(growth_cohort(m), m.p)


# ---------------------------------------------------------------- predicted segments
def scored_customers(m: Model) -> DataFrame:
    """The sampled customers that the forest scores, with their features."""
    ids = SM.sample_ids(m.data.ccids, m.p.scored_size, m.p.seed, strict=False)
    return RF.lob_spend_wide(m.data.tx.join(F.broadcast(ids), "ccid"), m.p)  # at most scored_size ids


@analysis
def rf_predicted_counts(m: Model) -> DataFrame:
    """Forest predictions on a customer sample, counted."""
    votes, labels = RF.forest_votes(RF.training_set(m.survey.tx, m.survey.answers, m.p), scored_customers(m), m.p)
    return RF.predicted_counts(RF.classes(votes, labels))


# ---------------------------------------------------------------- drill-through
def drill_through(m: Model, ccid: int) -> dict[str, DataFrame]:
    """One customer's lines in use-date order, bookings, and bookings with both tiers."""
    own = F.col("ccid") == ccid
    order = [F.col(c).asc_nulls_last() for c in ("begin_use_date", "booking_code")]
    return {"lines": T.customer_history(m.enriched, ccid),
            "bookings": m.booking_units.where(own).orderBy(*order),
            "tiers": tier_compare(m).where(own).orderBy(*order)}
