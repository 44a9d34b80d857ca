"""The main model job: segments, units, booking table and the two simulator inputs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Observation

from waypoint.operators import lines as L
from waypoint.operators import outputs as O
from waypoint.operators import reconcile as R
from waypoint.operators import segments as S
from waypoint.operators import units as U
from waypoint.operators.joins import hot_of
from waypoint.operators.sampling import sample_customers
from waypoint.operators.identity import Dataset
from waypoint.params import ModelParams
from waypoint.session import materialize
from waypoint.sources.cache import bucket_count, by_part, clustered_parts
from waypoint.sources.survey import SurveyDataset, levels_of


@dataclass
class Model:
    """Lazy nodes of the model; each property is built once per instance."""
    data: Dataset
    survey: SurveyDataset
    alt_raw: DataFrame | None
    p: ModelParams

    @property
    def hot(self) -> tuple:
        """Customers holding a large share of the lines (salted in joins on ccid)."""
        return self.data.hot_ccids

    @cached_property
    def tx(self) -> DataFrame:
        """The model's input lines: all, or a uniform customer sample in testing mode."""
        if self.p.testing:
            return sample_customers(self.data.tx, self.p.sample_size, self.p.seed)
        return self.data.tx

    @cached_property
    def answers(self) -> DataFrame:
        a = self.survey.answers
        if self.p.segmentation:
            if self.alt_raw is None:
                raise ValueError(f"segmentation {self.p.segmentation!r} needs the alternate segments file")
            a = S.override_segmentation(a, self.alt_raw, self.survey.cid_to_ccid,
                                        self.p.segmentation)
        return S.drop_non_members(a, self.p.segmentation)

    @property
    def segment_levels(self) -> tuple[str, ...]:
        """Level order of the segments: as given, else as the answers' codebook has it."""
        found = self.p.segment_levels or levels_of(self.answers, "segments_v1")
        return tuple(dict.fromkeys(S.FIXED_LEVEL if x == S.TYPO_LEVEL else x for x in found))

    @cached_property
    def typing(self) -> DataFrame:
        # tiny (cells x segments): written once, then counted, checked and broadcast
        return materialize(S.typing_table(self.survey.tx, self.answers, self.p), "typing")

    @cached_property
    def segments(self) -> DataFrame:
        return S.get_segments(self.parts, self.typing, self.answers, self.p)

    @cached_property
    def members(self) -> DataFrame:
        return L.members(self.data.cust, self.p)

    @cached_property
    def parts(self) -> tuple[DataFrame, ...]:
        """The lines as stored: clustered by customer, and the hot customers' apart."""
        return (self.tx,) if self.p.testing else self.data.tx_parts

    @cached_property
    def line_parts(self) -> tuple[DataFrame, ...]:
        """The line roll-up of both parts, clustered like the lines; its raw totals are observed as it is written."""
        rolled = [L.line_rollup(x, self.p) for x in self.parts]
        watched = [self.watch(f"raw{i}", x, R.raw_metrics(self.p)) for i, x in enumerate(rolled)]
        return clustered_parts(tuple(watched), "line-rollup", self.buckets)

    @property
    def buckets(self) -> int:
        """Those of the stored lines, so that what is derived from them is written without an exchange."""
        return self.data.buckets or bucket_count(self.data.tx.sparkSession, self.data.n_lines)

    @property
    def line_rollup(self) -> DataFrame:
        return by_part(self.line_parts, lambda df: df)

    def watch(self, name: str, df: DataFrame, metrics: dict) -> DataFrame:
        """``df`` with metrics taken while it is written; only for a frame whose last stage writes (a retried
        task of an earlier stage could count twice)."""
        self.observed[name] = Observation(name)
        return df.observe(self.observed[name], *[e.alias(m) for m, e in metrics.items()])

    @cached_property
    def observed(self) -> dict[str, Observation]:
        return {}

    @cached_property
    def codes(self) -> DataFrame:
        """One row a booking code: package flag, lines, use in the analysis year."""
        return materialize(L.code_totals(self.line_rollup, self.p), "booking-codes")

    @property
    def packages(self) -> DataFrame:
        return self.codes.select("booking_code", "n", "is_package")

    @cached_property
    def cust_dim(self) -> DataFrame:
        return self.segments.join(self.members.distinct(), "ccid", "left_semi")

    @cached_property
    def hot_codes(self) -> tuple:
        """Booking codes holding a large share of the lines (a missing code, say)."""
        return hot_of(self.codes, "booking_code", "n_lines")

    @cached_property
    def enriched(self) -> DataFrame:
        lines = (L.enriched_lines(self.parts, self.segments, self.packages, self.members, self.p, self.hot, self.hot_codes)
                 .select(*L.ENRICHED_COLUMNS))
        return materialize(self.watch("tx", lines, R.line_metrics(self.p)), "enriched-lines")

    @cached_property
    def by_lob_parts(self) -> tuple[DataFrame, ...]:
        """(booking, use year, LOB) rows of active customers, clustered like the lines; read by four consumers."""
        active = materialize(by_part(self.line_parts, lambda x: U.active_customers(x, self.cust_dim, self.p)), "active")
        rows = [U.active_booking_lobs(x, active, () if i == 0 and len(self.line_parts) > 1 else self.hot)
                for i, x in enumerate(self.line_parts)]
        return clustered_parts(tuple(rows), "booking-lob-years", self.buckets)

    @property
    def by_lob(self) -> DataFrame:
        return by_part(self.by_lob_parts, lambda df: df)

    def _by_booking(self, fn) -> DataFrame:
        """Work by customer on the (customer, booking, use year) roll-up, part by part."""
        return by_part(self.by_lob_parts, lambda x: fn(U.booking_years(None, self.p, by_lob=x), self.p))

    @cached_property
    def customer_units(self) -> DataFrame:
        return self._by_booking(U.customer_units)

    @cached_property
    def rollup(self) -> DataFrame:
        return self._by_booking(U.booking_rollup)

    @cached_property
    def running(self) -> DataFrame:
        return U.running_units(self.rollup)

    @cached_property
    def lob_wide(self) -> DataFrame:
        """The LOB table for every booking of active customers (the reference's table)."""
        return U.booking_lob_wide(self.by_lob, None, self.packages, self.p)

    @cached_property
    def lob_wide_year(self) -> DataFrame:
        """The same, only for bookings used in the analysis year (what the booking table joins)."""
        return U.booking_lob_wide(self.by_lob, None, self.packages, self.p,
                                  only_codes=self.rollup, hot_codes=self.hot_codes)

    @cached_property
    def booking_units(self) -> DataFrame:
        # the booking table feeds both outputs and the tier analytics: write it once
        table = U.booking_units(self.running, self.customer_units, self.lob_wide_year, self.p, self.hot, self.hot_codes)
        return materialize(self.watch("unit_calculation", table, R.booking_metrics()), "booking-units")

    @cached_property
    def stage_values(self) -> DataFrame:
        """(type, value) of every stage: totals observed while the stages were written, and counts by booking code."""
        return R.stage_values(self)

    @cached_property
    def bookings_out(self) -> DataFrame:
        return O.bookings_for_simulator(O.unit_views(self.booking_units), self.p)

    @cached_property
    def members_out(self) -> DataFrame:
        return O.members_for_simulator(self.booking_units, self.p)
