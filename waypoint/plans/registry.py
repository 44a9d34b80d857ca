"""Registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from waypoint.operators import forest as RF
from waypoint.operators import identity as I
from waypoint.operators import lines as L
from waypoint.operators import outputs as O
from waypoint.operators import respondents as RS
from waypoint.operators import sampling as SM
from waypoint.operators import segments as S
from waypoint.operators import tiers as T
from waypoint.plans import analyses as A
from waypoint.plans import context
from waypoint.plans.model import Model
from waypoint.session import materialize, scratch_path
from waypoint.sources import cache as CACHE
from waypoint.sources import csv as CSV
from waypoint.sources import fixtures as FX
from waypoint.sources.survey import cid_to_ccid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_MODELS: dict = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def as_output(df: DataFrame) -> DataFrame:
    """Money leaves the engine as double (sums were exact decimals)."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name)
                       if isinstance(f.dataType, DecimalType) else F.col(f.name)
                       for f in df.schema.fields])


def model(spark: SparkSession, sf_dir: str) -> Model:
    ctx = context.load(spark, sf_dir)
    held = _MODELS.get(id(ctx))
    if held is None or held[0] is not ctx:  # the context is held, so its id is not used again
        held = _MODELS[id(ctx)] = (ctx, Model(ctx.lines, ctx.survey, ctx.alt_raw, ctx.params))
    return held[1]


@query("bookings_for_simulator")
def q_bookings_for_simulator(spark, sf):
    """Bookings by segment and units earned, scaled and rounded."""
    return model(spark, sf).bookings_out


@query("members_for_simulator")
def q_members_for_simulator(spark, sf):
    """Members, value, bookings, units, packages and LOB totals, scaled and rounded."""
    return model(spark, sf).members_out


# ---------------------------------------------------------------- helpers
def ctx(spark, sf):
    return context.load(spark, sf)


def _p(spark, sf):
    return ctx(spark, sf).params


# ---------------------------------------------------------------- ingest and identity
@query("tx_normalised")
def q_tx_normalised(spark, sf):
    """Raw extract with the three renames and lower-cased LOB."""
    return as_output(I.post_process_tx(ctx(spark, sf).tx_extract))


@query("customer_ids")
def q_customer_ids(spark, sf):
    """Dense customer ids over both tables' natural keys."""
    return ctx(spark, sf).ids.ccids


@query("attach_ccid")
def q_attach_ccid(spark, sf):
    """Customer table with ccid in place of the natural key."""
    return ctx(spark, sf).ids.cust


@query("tx_year_slice")
def q_tx_year_slice(spark, sf):
    """Lines used in the analysis year, with year and month."""
    c = ctx(spark, sf)
    return (L.year_slice(c.lines.tx, c.params.analysis_year)
            .select("ccid", "booking_code", "begin_use_date",
                    F.year("begin_use_date").alias("use_year"),
                    F.month("begin_use_date").alias("use_month")))


@query("scan_customer_csv")
def q_scan_customer_csv(spark, sf):
    """Customer CSV read by header name with null tokens."""
    path = scratch_path(spark, "customers-csv")
    CSV.write_csv(ctx(spark, sf).cust_extract, path, null_value="")
    return CSV.read_customers(spark, path)


def _write_tx_parts(spark, sf) -> str:
    """The extract as three numbered parts (by use period), columns in different orders."""
    x = ctx(spark, sf).tx_extract
    folder = scratch_path(spark, "tx-parts")
    d = F.col("begin_use_date")
    spans = [d < F.lit(_dt.date(1997, 1, 1)),
             (d >= F.lit(_dt.date(1997, 1, 1))) & (d < F.lit(_dt.date(1999, 1, 1))),
             (d >= F.lit(_dt.date(1999, 1, 1))) | d.isNull()]
    cols = x.columns
    for i, cond in enumerate(spans, start=1):
        order = cols if i % 2 else list(reversed(cols))
        CSV.write_csv(x.where(cond).select(*order), f"{folder}/extract_tx{i}of3.csv", null_value="")
    # an entry that does not match the part pattern must be ignored
    CSV.write_csv(x.select("boooking_code").limit(1), f"{folder}/extract_tx_notes.csv")
    return folder


@query("scan_tx_parts")
def q_scan_tx_parts(spark, sf):
    """Numbered part files with differing column orders."""
    return as_output(CSV.read_tx_parts(spark, _write_tx_parts(spark, sf)))


@query("read_faults")
def q_read_faults(spark, sf):
    """Cells that the typed read loses or rounds, counted, from parts with spoilt dates, units and amounts."""
    x = ctx(spark, sf).tx_extract
    folder = scratch_path(spark, "tx-spoilt")
    text = lambda c: F.col(c).cast("string")
    every = lambda m: F.coalesce(F.col("boooking_code") % m == 0, F.lit(False))
    spoilt = x.withColumns({
        "begin_use_date": F.when(every(17), F.concat(text("begin_use_date"), F.lit("x"))).otherwise(text("begin_use_date")),
        "unit_count": F.when(every(11) & F.col("unit_count").isNotNull(), F.lit("n/a")).otherwise(text("unit_count")),
        "gross_booking_amount_usd": F.when(every(13), F.concat(text("gross_booking_amount_usd"), F.lit("4")))
        .otherwise(text("gross_booking_amount_usd"))})
    CSV.write_csv(spoilt, f"{folder}/extract_tx1of1.csv", null_value="")
    read = materialize(CSV.read_tx_parts(spark, folder, faults=True), "tx-extract")
    return CSV.fault_counts(CSV.faulty_cells(read, "transactions"))


@query("cache_roundtrip")
def q_cache_roundtrip(spark, sf):
    """Parquet cache write, discovery and memoised scan."""
    d = ctx(spark, sf).ids  # the lines with ids, stored here for the first time
    folder = scratch_path(spark, "raw-cache")
    CACHE.write_tables({"cust": d.cust, "tx": d.tx, "ccids": d.ccids}, folder, d.hot_ccids,
                       CACHE.bucket_count(spark, d.n_lines), d.parts, d.by_year)
    tables = CACHE.read_tables(spark, folder)
    tx = CACHE.by_part(CACHE.tx_parts(tables), lambda df: df)
    # memoised scan: the first call builds and stores, the second reads the stored table
    memo = f"{folder}-memo/tx"
    CACHE.load_or_build(spark, memo, lambda: tx)
    return as_output(CACHE.load_or_build(spark, memo, lambda: tx.limit(0)))


# ---------------------------------------------------------------- survey
@query("survey_id_map")
def q_survey_id_map(spark, sf):
    """Survey id map CSV ('null' only) to ccid, null-safe."""
    c = ctx(spark, sf)
    path = scratch_path(spark, "survey-map")
    CSV.write_csv(FX.survey_map_extract(spark, sf), path, null_value="null")
    return cid_to_ccid(c.survey.ccids, CSV.read_survey_map(spark, path))


@query("survey_dataset")
def q_survey_dataset(spark, sf):
    """Cleaned labelled responses with ccid (left join)."""
    return ctx(spark, sf).survey.answers


@query("override_segmentation")
def q_override_segmentation(spark, sf):
    """Alternate segmentation replaces segments_v1."""
    c = ctx(spark, sf)
    path = scratch_path(spark, "alt-segments")
    CSV.write_csv(c.alt_raw, path)
    alt = CSV.read_all_text(spark, path)
    a = S.override_segmentation(c.survey.answers, alt, c.survey.cid_to_ccid, "tier_expanded")
    return S.drop_non_members(a, "tier_expanded")


@query("unique_only")
def q_unique_only(spark, sf):
    """Alternate segments of customers that occur once."""
    c = ctx(spark, sf)
    alt = S.clean_names(c.alt_raw).withColumnRenamed("cid_external_cid", "cid")
    alt = alt.join(c.survey.cid_to_ccid, "cid")
    return S.unique_only(alt.select("ccid", F.col("tier_expanded").alias("segments_v1")), "ccid")


# ---------------------------------------------------------------- segmentation
@query("spend_cut_wide")
def q_spend_cut_wide(spark, sf):
    """Analysis-year air/lodging spend cuts per customer."""
    c = ctx(spark, sf)
    return S.spend_cut_wide(c.data.tx, c.params)


@query("typing_table")
def q_typing_table(spark, sf):
    """P(segment | spend cell) from respondents."""
    c = ctx(spark, sf)
    return S.typing_table(c.survey.tx, c.survey.answers, c.params)


@query("segment_candidates")
def q_segment_candidates(spark, sf):
    """Customers with every segment of their spend cell."""
    m = model(spark, sf)
    return S.segment_candidates(m.data.tx, m.typing, m.p)


@query("segment_assignment")
def q_segment_assignment(spark, sf):
    """One drawn segment per customer, default for the rest."""
    return model(spark, sf).segments


@query("unsegmented_customers")
def q_unsegmented_customers(spark, sf):
    """Lines of customers without a drawn segment (before the default level fills them)."""
    whole = ctx(spark, sf).data  # every column of the lines
    m = model(spark, sf)
    return as_output(S.unplaced_lines(whole.tx_parts, m.typing, m.p, m.hot).drop("use_year"))


# ---------------------------------------------------------------- model stages
@query("members")
def q_members(spark, sf):
    """customers joined by the analysis year."""
    return model(spark, sf).members


@query("package_flags")
def q_package_flags(spark, sf):
    """A1: bookings with more than one eligible LOB."""
    return model(spark, sf).packages.withColumn("n", F.col("n").cast("long"))


@query("tx_enriched")
def q_tx_enriched(spark, sf):
    """The model's qualifying lines with segment and extended LOB."""
    return as_output(model(spark, sf).enriched)


@query("current_year_units")
def q_current_year_units(spark, sf):
    """Analysis-year units and distinct bookings per customer."""
    return model(spark, sf).customer_units.select(
        "ccid", "trip_elements_current_year", "bookings_current_year")


@query("prev_year_units")
def q_prev_year_units(spark, sf):
    """Previous-year units of customers active this year."""
    return (model(spark, sf).customer_units.where(F.col("bookings_prev_year").isNotNull())
            .select("ccid", "trip_elements_prev_year", "bookings_prev_year"))


@query("booking_lob_wide")
def q_booking_lob_wide(spark, sf):
    """A4: value, presence and units per extended LOB per booking."""
    return as_output(model(spark, sf).lob_wide)


@query("booking_rollup")
def q_booking_rollup(spark, sf):
    """A5: one row per booking used in the analysis year."""
    return as_output(model(spark, sf).rollup)


@query("running_units")
def q_running_units(spark, sf):
    """Units and bookings earned before each booking."""
    return as_output(model(spark, sf).running)


@query("booking_units")
def q_booking_units(spark, sf):
    """The booking table, filled and capped."""
    return as_output(model(spark, sf).booking_units)


@query("unit_views")
def q_unit_views(spark, sf):
    """Each booking in trip elements and in bookings."""
    return as_output(O.unit_views(model(spark, sf).booking_units))


@query("sink_roundtrip")
def q_sink_roundtrip(spark, sf):
    """Bookings output written as CSV and read back."""
    m = model(spark, sf)
    out = m.bookings_out
    base = scratch_path(spark, "model-output")
    path = CSV.write_output(out, base, "run", "bookings",
                            order=O.output_order(m.segment_levels))
    return CSV.read_output(spark, path, out)


@query("sample_customers")
def q_sample_customers(spark, sf):
    """Lines of a seeded uniform sample of customers."""
    c = ctx(spark, sf)
    return as_output(SM.sample_customers(c.data.tx, c.params.sample_size, c.params.seed)
                     .drop("use_year"))


# ---------------------------------------------------------------- respondent features
def _survey_year(c):
    return L.year_slice(c.survey.tx, c.params.analysis_year)


@query("lob_metrics_wide")
def q_lob_metrics_wide(spark, sf):
    """A10: five metrics per customer and LOB, wide."""
    c = ctx(spark, sf)
    rolled = RS.respondent_rollup(_survey_year(c))
    return as_output(RS.lob_metrics_wide(rolled, RS.lob_levels(rolled)))


@query("flag_sums")
def q_flag_sums(spark, sf):
    """Flag and quantity sums per customer, missing if any input is."""
    return RS.flag_sums(RS.respondent_rollup(_survey_year(ctx(spark, sf))))


@query("survey_features")
def q_survey_features(spark, sf):
    """The respondent feature table."""
    c = ctx(spark, sf)
    return as_output(RS.survey_features(c.survey.cid_to_ccid, c.survey.ccids, c.survey.tx,
                                        c.params.analysis_year))


@query("customer_history")
def q_customer_history(spark, sf):
    """One customer's lines in use-date order."""
    m = model(spark, sf)
    busiest = (L.year_slice(m.enriched, m.p.analysis_year).groupBy("ccid")
               .agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.desc("n"), "ccid").limit(1).select("ccid").scalar())
    return T.customer_history(m.enriched, busiest)


# ---------------------------------------------------------------- transitions
@query("units_compare")
def q_units_compare(spark, sf):
    """Current and previous-year units of active members."""
    uc = A.units_compare(model(spark, sf))
    return uc.withColumns({c: F.col(c).cast("double") for c in
                           ("trip_elements_current_year", "trip_elements_prev_year")})


@query("growth_cohort")
def q_growth_cohort(spark, sf):
    """F8: one booking last year, 2..band this year."""
    return A.growth_cohort(model(spark, sf))


# ---------------------------------------------------------------- random forest
@query("rf_training_set")
def q_rf_training_set(spark, sf):
    """Spend features with the survey segment."""
    c = ctx(spark, sf)
    return RF.training_set(c.survey.tx, c.survey.answers, c.params)


@query("rf_scored_customers")
def q_rf_scored_customers(spark, sf):
    """M1, M3: the sampled customers that the forest scores, with their features."""
    return A.scored_customers(model(spark, sf))


@query("typing_table_override")
def q_typing_table_override(spark, sf):
    """The typing table the model uses: alternate segmentation, non-members removed."""
    return model(spark, sf).typing


@query("shared_booking_codes")
def q_shared_booking_codes(spark, sf):
    """How many booking codes of the year's booking table several customers share."""
    from waypoint.operators.units import shared_booking_codes
    return shared_booking_codes(model(spark, sf).booking_units)


# ---------------------------------------------------------------- analyses
def _of_model(fn):
    return lambda spark, sf: fn(model(spark, sf))


QUERIES.update({name: _of_model(fn) for name, fn in A.ANALYSES.items()})
