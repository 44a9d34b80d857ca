"""Readers match columns by header name; null tokens; cache and sink."""

import os
import tempfile
from decimal import Decimal

import pytest

from waypoint.sources import cache, csv


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_tx_parts_by_header_name(spark):
    d = tempfile.mkdtemp(prefix="waypoint-io-")
    _write(f"{d}/x_tx1of2.csv",
           "boooking_code,unit_count,line_of_business,gross_booking_amount_usd,begin_use_date\n"
           "B1,2,Air,10.50,2024-01-02\nB2,NA,Car,null,\n")
    # same columns, swapped order; plus an extra unlisted column
    _write(f"{d}/x_tx2of2.csv",
           "begin_use_date,junk,gross_booking_amount_usd,line_of_business,unit_count,boooking_code\n"
           "2024-02-03,zz,7.25,Lodging,3,B3\n")
    _write(f"{d}/x_notes.csv", "boooking_code\nNOPE\n")
    df = csv.read_tx_parts(spark, d)
    assert "junk" not in df.columns and len(df.columns) == 30
    rows = {r.boooking_code: r for r in df.collect()}
    assert set(rows) == {"B1", "B2", "B3"}
    assert rows["B3"].unit_count == 3.0 and rows["B3"].line_of_business == "Lodging"
    assert rows["B3"].gross_booking_amount_usd == Decimal("7.25")  # six places, not rounded to cents
    assert rows["B2"].unit_count is None and rows["B2"].gross_booking_amount_usd is None
    assert rows["B2"].begin_use_date is None


def test_customer_reader_tokens_and_extra_columns(spark):
    d = tempfile.mkdtemp(prefix="waypoint-io-")
    _write(f"{d}/cust.csv", "parallax_hashed_email_address,first_ever_bex_ok_join_date,n_burns_lifetime,extra\n"
                            "h1,null,3,a\nh2,2020-01-01,NA,\n")
    rows = {r.parallax_hashed_email_address: r for r in csv.read_customers(spark, f"{d}/cust.csv").collect()}
    assert rows["h1"].first_ever_bex_ok_join_date is None and rows["h1"].n_burns_lifetime == 3.0
    assert rows["h2"].n_burns_lifetime is None and rows["h1"].extra == "a" and rows["h2"].extra is None


def test_survey_map_keeps_empty_string(spark):
    d = tempfile.mkdtemp(prefix="waypoint-io-")
    _write(f"{d}/map.csv", 'parallax_hashed_email_address,cid\n"",S1\nnull,S2\n')
    rows = {r.cid: r.parallax_hashed_email_address for r in csv.read_survey_map(spark, f"{d}/map.csv").collect()}
    assert rows == {"S1": "", "S2": None}


def test_empty_cache_raises(spark):
    with pytest.raises(FileNotFoundError, match="empty"):
        cache.read_tables(spark, tempfile.mkdtemp(prefix="waypoint-empty-"))


def test_load_or_build_builds_once(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="waypoint-lob-"), "t.parquet")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    assert cache.load_or_build(spark, path, build).count() == 3
    assert cache.load_or_build(spark, path, build).count() == 3
    assert len(calls) == 1


def test_output_names_and_roundtrip(spark):
    df = spark.createDataFrame([("a", 1.0, None)], "seg_name string, units_earned double, x_y double")
    base = tempfile.mkdtemp(prefix="waypoint-out-")
    path = csv.write_output(df, base, "run1", "bookings")
    back = csv.read_output(spark, path, df)
    assert back.columns == ["seg name", "units earned", "x y"]
    assert [tuple(r) for r in back.collect()] == [("a", 1.0, None)]


def test_all_text_reader_default_null_tokens(spark):
    d = tempfile.mkdtemp(prefix="waypoint-io-")
    _write(f"{d}/alt.csv", "CID External CID,Tier Expanded\nS1,NA\nS2,\nS3,null\n")
    rows = {r["CID External CID"]: r["Tier Expanded"] for r in csv.read_all_text(spark, f"{d}/alt.csv").collect()}
    assert rows == {"S1": None, "S2": None, "S3": "null"}


def test_run_scratch_removes_its_folder(spark):
    from waypoint.session import materialize, run_scratch
    from waypoint.sources import files
    with run_scratch(spark, "t") as folder:
        df = materialize(spark.range(5), "stage")
        assert df.count() == 5
        assert files.exists(spark, folder)
    assert not files.exists(spark, folder)
