"""The jobs of the model, from extract files to output files.

* ``ingest_job``: customer CSV + numbered transaction parts -> ids -> Parquet cache, with a
  quarantine of the cells that the typed read loses or rounds.
* ``model_job``: cache + survey -> segments, units -> ``bookings`` and ``members`` CSVs.
* ``respondent_job``: survey -> one wide row per respondent -> ``join-data`` CSV.
* ``analyses_job``: cache + survey -> tiers, transitions, growth, reconciliation, predicted
  segments, and single customers -> a CSV each.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from waypoint.operators.identity import Dataset, post_process_tx, process_ccids
from waypoint.operators.joins import DEFAULT_SHARE
from waypoint.operators.outputs import output_order
from waypoint.operators.respondents import survey_features
from waypoint.params import ModelParams
from waypoint.plans.analyses import ANALYSES, drill_through
from waypoint.plans.context import ingest, store, stored
from waypoint.plans.model import Model
from waypoint.session import materialize, run_scratch
from waypoint.sources import cache, csv
from waypoint.sources.survey import SurveyDataset, codebook, decoded, read_codebook, survey_dataset, value_labels


@dataclass(frozen=True)
class SurveyInputs:
    """Survey side: its own customer / transaction extracts, id map, responses."""
    cust_csv: str
    tx_folder: str
    map_csv: str
    responses: DataFrame
    alt_csv: str | None = None
    # texts and level order of coded answers (and of the alternate segments), see ``read_codebook``
    codebook_csv: str | None = None
    # texts of coded answers without a codebook file: raw column -> code -> text
    value_labels: dict[str, dict[str, str]] | None = None


def whole_numbers(df: DataFrame) -> DataFrame:
    """Rounded double columns as integers, so the CSV holds ``1234`` rather than ``1234.0``."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name)
                       if isinstance(f.dataType, DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def run_id(segmentation: str | None, now: dt.datetime | None = None) -> str:
    """Timestamp run id, suffixed with the override segmentation when there is one."""
    rid = (now or dt.datetime.now()).strftime("%Y%m%d---%H%M%S")
    return f"{rid}---segment-{segmentation}" if segmentation else rid


def read_extracts(spark: SparkSession, cust_csv: str, tx_folder: str) -> tuple[Dataset, DataFrame]:
    """The extracts with ids, and the cells that their typed read lost or rounded."""
    # parsed once: the id pass then reads only the key column of the stored extracts
    cust = materialize(csv.read_customers(spark, cust_csv, faults=True), "customer-extract")
    tx = materialize(post_process_tx(csv.read_tx_parts(spark, tx_folder, faults=True)), "tx-extract")
    faults = csv.faulty_cells(cust, "customers").unionByName(csv.faulty_cells(tx, "transactions"))
    return process_ccids(cust.drop(csv.FAULTS), tx.drop(csv.FAULTS)), faults


def ingest_job(spark: SparkSession, cust_csv: str, tx_folder: str, cache_folder: str) -> DataFrame:
    """Returns the counts of faulty cells; the cells lie in the cache as ``faults``."""
    with run_scratch(spark, "ingest-run"):
        d, faults = read_extracts(spark, cust_csv, tx_folder)
        hot = spark.createDataFrame([(k,) for k in d.hot_ccids], "ccid long")
        store(spark, d, cache_folder)
        cache.write_table(hot, f"{cache_folder}/hot")
        cache.write_table(faults, f"{cache_folder}/faults")
    return csv.fault_counts(spark.read.parquet(f"{cache_folder}/faults"))


def read_cache(spark: SparkSession, cache_folder: str) -> Dataset:
    t = cache.read_tables(spark, cache_folder)
    hot = tuple(r[0] for r in t["hot"].collect()) if "hot" in t else ()
    if len(hot) > 2 / DEFAULT_SHARE:  # each listed key exceeds the share in one of two tables
        raise AssertionError(f"{len(hot)} hot keys stored; the list is not the ingest's")
    return stored(spark, cache_folder, hot)


def read_survey(spark: SparkSession, s: SurveyInputs) -> SurveyDataset:
    # parsed once: every consumer reads the stored lines, by use year
    own = ingest(spark, read_extracts(spark, s.cust_csv, s.tx_folder)[0])
    responses = value_labels(s.responses, s.value_labels or {})
    if s.codebook_csv:
        responses = decoded(responses, read_codebook(spark, s.codebook_csv))
    return survey_dataset(own, csv.read_survey_map(spark, s.map_csv), responses, codebook(spark, responses))


def read_alt(spark: SparkSession, s: SurveyInputs) -> DataFrame | None:
    if not s.alt_csv:
        return None
    alt = csv.read_all_text(spark, s.alt_csv)
    return decoded(alt, read_codebook(spark, s.codebook_csv)) if s.codebook_csv else alt


def model_job(spark: SparkSession, cache_folder: str, survey: SurveyInputs,
              p: ModelParams, out_dir: str, rid: str | None = None) -> dict[str, str]:
    rid = rid or run_id(p.segmentation)
    with run_scratch(spark, "model-run"):
        data = read_cache(spark, cache_folder)
        m = Model(data, read_survey(spark, survey), read_alt(spark, survey), p)
        order = output_order(m.segment_levels)
        return {
            "bookings": csv.write_output(whole_numbers(m.bookings_out), out_dir, rid,
                                         "bookings", order),
            "members": csv.write_output(whole_numbers(m.members_out), out_dir, rid,
                                        "members", order[:5]),
        }


def respondent_job(spark: SparkSession, survey: SurveyInputs, year: int, out_dir: str,
                   rid: str | None = None) -> str:
    with run_scratch(spark, "respondent-run"):
        sv = read_survey(spark, survey)
        table = survey_features(sv.cid_to_ccid, sv.ccids, sv.tx, year)
        return csv.write_output(table, out_dir, rid or run_id(None), "join-data", spaces=False)


def analyses_job(spark: SparkSession, cache_folder: str, survey: SurveyInputs, p: ModelParams, out_dir: str,
                 rid: str | None = None, only: tuple[str, ...] = (), customers: tuple[int, ...] = ()) -> dict[str, str]:
    """The analyses of one model run (all, or those named by ``only``) and the rows of single
    ``customers``, each as a CSV folder under ``out_dir/<run id>``; their paths by name."""
    unknown = set(only) - set(ANALYSES)
    if unknown:
        raise ValueError(f"no such analysis: {', '.join(sorted(unknown))}; available: {', '.join(ANALYSES)}")
    rid = rid or run_id(p.segmentation)
    with run_scratch(spark, "analyses-run"):
        m = Model(read_cache(spark, cache_folder), read_survey(spark, survey), read_alt(spark, survey), p)
        tables = {name: ANALYSES[name](m) for name in (only or ANALYSES)}
        for c in customers:
            tables |= {f"customer-{c}-{name}": df for name, df in drill_through(m, c).items()}
        return {name: csv.write_output(df, out_dir, rid, name, spaces=False) for name, df in tables.items()}
