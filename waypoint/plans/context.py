"""Build the model's inputs from a folder of driver tables (memoised per session)."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.operators.identity import Dataset, post_process_tx, process_ccids
from waypoint.session import materialize, scratch_path
from waypoint.sources.cache import CODEC, YEAR, bucket_count, buckets_of, by_part, read_tables, tx_parts, write_tables
from waypoint.params import ModelParams, fixture_params
from waypoint.sources import csv
from waypoint.sources import fixtures as fx
from waypoint.sources.survey import SurveyDataset, codebook, decoded, read_codebook, survey_dataset

#: Columns of the lines that the model and the analyses read.
MODEL_COLUMNS = ("ccid", "booking_code", "eg_brand_code", "lob", "unit_count", "gbv", "booking_date_pst",
                 "begin_use_date", "loyalty_tier")

# Fixture question texts for survey columns that are labelled without a codebook.
QUESTION_LABELS = {
    "CID_External": "Respondent identifier",
    "Segments_V1": "Traveller segment (first segmentation)",
    "Q1_Trips": "How many trips did you take in the last twelve months?",
}


@dataclass(frozen=True)
class Context:
    """The inputs of the model; each is made when a query first needs it, and once."""
    spark: SparkSession
    sf_dir: str
    params: ModelParams

    @cached_property
    def extract(self) -> DataFrame:
        """The lines as files (as the model receives them), by use year, the survey's own marked."""
        # like rows side by side: a customer's lines, which makes files and later exchanges smaller
        first, *more = [x.withColumn(YEAR, F.year("begin_use_date")).sortWithinPartitions(YEAR, fx.NATURAL_KEY, "boooking_code")
                        for x in fx.tx_extracts(self.spark, self.sf_dir)]
        return materialize(first, "tx-extract", partition_by=[YEAR], more=more, compression=CODEC)

    @property
    def tx_extract(self) -> DataFrame:
        return self.extract.drop(fx.SURVEYED, YEAR)

    @property
    def cust_extract(self) -> DataFrame:
        return fx.customer_extract(self.spark, self.sf_dir)

    @cached_property
    def ids(self) -> Dataset:
        """Both tables with ids; the id pass reads only the key column, the lines are not stored."""
        return process_ccids(self.cust_extract, post_process_tx(self.extract.drop(fx.SURVEYED)))

    @cached_property
    def data(self) -> Dataset:
        return ingest(self.spark, self.ids)

    @cached_property
    def lines(self) -> Dataset:
        """``data`` as the model reads it: stored with the columns that the model and the analyses use of more than 30
        (all rows), unless the whole lines are stored already."""
        if "data" in self.__dict__:
            return self.data
        parts = tuple(x.select(*MODEL_COLUMNS, YEAR) for x in self.ids.parts)
        return ingest(self.spark, replace(self.ids, tx=by_part(parts, lambda x: x), parts=parts))

    @cached_property
    def survey(self) -> SurveyDataset:
        # coded answers and their codebook, both as files
        book = scratch_path(self.spark, "codebook")
        csv.write_csv(fx.codebook_extract(self.spark).coalesce(1), book, null_value="")
        responses = decoded(fx.survey_responses_extract(self.spark, self.sf_dir, coded=True),
                            read_codebook(self.spark, book))
        # the survey's own extracts, numbered apart from the main ones; every consumer reads a year or two
        # of the stored extract's lines, which are fewer than all of them to be stored again
        own = process_ccids(fx.customer_extract(self.spark, self.sf_dir, survey=True),
                            post_process_tx(self.extract.where(fx.SURVEYED).drop(fx.SURVEYED)))
        own = replace(own, cust=materialize(own.cust, "survey-customers"), ccids=materialize(own.ccids, "survey-ids"))
        return survey_dataset(own, fx.survey_map_extract(self.spark, self.sf_dir), responses,
                              codebook(self.spark, responses))

    @property
    def alt_raw(self) -> DataFrame:
        return fx.alt_segments_extract(self.spark, self.sf_dir)


_CACHE: dict = {}


def ingest(spark: SparkSession, data: Dataset, folder: str | None = None) -> Dataset:
    """Entry A: write the id-attached tables to the Parquet cache and read them back.

    ``tx`` carries its ``use_year`` partition column, which the year filters
    of the model use to prune.
    """
    folder = folder or scratch_path(spark, "raw-cache")
    store(spark, data, folder)
    return stored(spark, folder, data.hot_ccids)


def store(spark: SparkSession, data: Dataset, folder: str) -> None:
    write_tables({"cust": data.cust, "tx": data.tx, "ccids": data.ccids}, folder, data.hot_ccids,
                 bucket_count(spark, data.n_lines), data.parts, data.by_year)


def stored(spark: SparkSession, folder: str, hot: tuple) -> Dataset:
    t = read_tables(spark, folder)
    parts = tx_parts(t)
    return Dataset(cust=t["cust"], tx=by_part(parts, lambda df: df), ccids=t["ccids"], hot_ccids=hot, parts=parts,
                   buckets=buckets_of(spark, f"{folder}/tx"))


def load(spark: SparkSession, sf_dir: str, params: ModelParams | None = None) -> Context:
    params = params or fixture_params()
    key = (id(spark), spark.conf.get("spark.app.id", ""), sf_dir.rstrip("/"), params)
    hit = _CACHE.get(key)
    if hit is not None:
        return hit
    ctx = Context(spark, sf_dir, params)
    _CACHE[key] = ctx
    return ctx
