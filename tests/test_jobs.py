"""The three jobs end to end on CSV extracts written from the small fixture."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from waypoint.plans import jobs
from waypoint.plans.context import QUESTION_LABELS
from waypoint.sources import csv
from waypoint.sources import fixtures as fx
from waypoint.sources.survey import label_columns
from waypoint.params import fixture_params


def test_jobs_end_to_end(spark):
    root = tempfile.mkdtemp(prefix="waypoint-jobs-")
    tx = fx.tx_extract(spark, SF_SMALL)
    csv.write_csv(fx.customer_extract(spark, SF_SMALL), f"{root}/cust.csv", null_value="")
    csv.write_csv(tx.where(F.year("begin_use_date") < 1998), f"{root}/raw/a_tx1of2.csv", null_value="")
    csv.write_csv(tx.where((F.year("begin_use_date") >= 1998) | F.col("begin_use_date").isNull()),
                  f"{root}/raw/a_tx2of2.csv", null_value="")
    csv.write_csv(fx.survey_map_extract(spark, SF_SMALL), f"{root}/map.csv", null_value="null")
    csv.write_csv(fx.alt_segments_extract(spark, SF_SMALL), f"{root}/alt.csv")
    jobs.ingest_job(spark, f"{root}/cust.csv", f"{root}/raw", f"{root}/cache")
    csv.write_csv(fx.customer_extract(spark, SF_SMALL, survey=True), f"{root}/survey_cust.csv", null_value="")
    csv.write_csv(fx.tx_extract(spark, SF_SMALL, survey=True), f"{root}/survey_raw/s_tx1of1.csv", null_value="")
    survey = jobs.SurveyInputs(
        cust_csv=f"{root}/survey_cust.csv", tx_folder=f"{root}/survey_raw", map_csv=f"{root}/map.csv",
        responses=fx.survey_responses_extract(spark, SF_SMALL, coded=True),
        alt_csv=f"{root}/alt.csv", codebook_csv=f"{root}/book.csv")
    tiers = ("Non-Member", "Platinum", "Gold", "Silver", "Blue")
    csv.write_csv(fx.codebook_extract(spark).unionByName(spark.createDataFrame(
        [("Tier Expanded", "Tier", t, t, str(i)) for i, t in enumerate(tiers)],
        "question string, question_text string, code string, label string, position string")),
        f"{root}/book.csv", null_value="")
    p = fixture_params()
    out = jobs.model_job(spark, f"{root}/cache", survey, p, f"{root}/out", rid="r1")
    bookings = csv.read_text_csv(spark, out["bookings"], null_value="NA")
    assert "units earned start of booking" in bookings.columns and bookings.count() > 0
    types = [r["unit type"] for r in bookings.collect()]
    assert types == sorted(types, reverse=True) and len(set(types)) == 2  # trip elements first
    segments = [tiers.index(r["segment"]) for r in bookings.where("`unit type` = 'bookings'").collect()]
    assert segments == sorted(segments) and len(set(segments)) > 2  # in the codebook's order
    members = csv.read_text_csv(spark, out["members"], null_value="NA")
    assert "num members" in members.columns and members.count() > 0
    # the CSV path reads booking codes as text (as the extracts hold them): same-day
    # bookings then tie-break in text order; otherwise it is the oracle's model
    import sys
    sys.path.insert(0, ".")
    from tools.oracle_check import duck
    from waypoint.plans.oracle import ORACLE
    from waypoint.plans.registry import QUERIES
    con = duck(SF_SMALL)
    sql = ORACLE["bookings_for_simulator"].replace(
        "ORDER BY begin_use_date, booking_code, segment",
        "ORDER BY begin_use_date, CAST(booking_code AS VARCHAR), segment")
    like = QUERIES["bookings_for_simulator"](spark, SF_SMALL)
    got = csv.read_output(spark, out["bookings"], like)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(sql).fetchall())
    like_m = QUERIES["members_for_simulator"](spark, SF_SMALL)
    got_m = csv.read_output(spark, out["members"], like_m).toDF(*like_m.columns)
    want_m = con.execute(ORACLE["members_for_simulator"])
    cols = [d[0] for d in want_m.description]
    assert sorted(tuple(r) for r in got_m.select(*cols).collect()) == sorted(want_m.fetchall())
    check_analyses(spark, f"{root}/cache", survey, p, f"{root}/out", con)
    path = jobs.respondent_job(spark, survey, p.analysis_year, f"{root}/out", rid="r1")
    resp = csv.read_text_csv(spark, path, null_value="NA")
    assert resp.columns[:2] == ["cid", "parallax_hashed_email_address"]  # only the simulator files rename
    assert resp.count() == fx.survey_map_extract(spark, SF_SMALL).count()


def check_analyses(spark, cache_folder, survey, p, out, con):
    """Analyses that do not depend on the order of booking codes equal their oracle, from files to files."""
    from waypoint.plans.analyses import ANALYSES
    from waypoint.plans.oracle import ORACLE
    from waypoint.plans.registry import QUERIES
    names = ("stage_reconciliation", "recorded_tier_distribution", "monthly_tier_mix", "unit_transitions",
             "survey_unit_transitions", "growth_multipliers", "daily_bookings")
    who = QUERIES["booking_units"](spark, SF_SMALL).agg(F.max("ccid")).first()[0]  # ids follow the natural keys
    paths = jobs.analyses_job(spark, cache_folder, survey, p, out, rid="r1", only=names, customers=(who,))
    assert set(paths) == {*names, *(f"customer-{who}-{x}" for x in ("lines", "bookings", "tiers"))}
    for name in names:
        like = QUERIES[name](spark, SF_SMALL)
        types = {f.name: f.dataType.simpleString() for f in like.schema.fields}
        got = csv.project(csv.read_text_csv(spark, paths[name], null_value="NA"), types, False, tokens=("NA",))
        cur = con.execute(ORACLE[name])
        want = [dict(zip([d[0] for d in cur.description], r)) for r in cur.fetchall()]
        key = lambda r: repr([r[c] for c in types])
        assert sorted(key(r.asDict()) for r in got.collect()) == sorted(map(key, want)), name
    lines = csv.read_text_csv(spark, paths[f"customer-{who}-lines"], null_value="NA")
    dates = [r.begin_use_date or "9" for r in lines.collect()]
    assert dates and dates == sorted(dates)
    with pytest.raises(ValueError, match="no such analysis"):
        jobs.analyses_job(spark, cache_folder, survey, p, out, only=("nothing",))
    assert set(names) < set(ANALYSES)


def test_ingest_accounts_for_lost_cells(spark):
    root = tempfile.mkdtemp(prefix="waypoint-faults-")
    tx = spark.createDataFrame(
        [("a", "1", "BR1", "Air", "2", "10.125", "1998-01-05"), ("a", "2", "BR1", "Air", "many", "5", "1998-13-05"),
         ("b", "3", "BR1", "Air", "1", "0.0000004", "NA"), (None, "4", "BR1", "Car", "1", "9999999999999", "1998-02-01")],
        "parallax_hashed_email_address string, boooking_code string, eg_brand_code string, line_of_business string, "
        "unit_count string, gross_booking_amount_usd string, begin_use_date string")
    csv.write_csv(tx, f"{root}/raw/x_tx1of1.csv", null_value="")
    csv.write_csv(spark.createDataFrame([("a", "soon"), ("b", "1997-02-03")],
                                        "parallax_hashed_email_address string, first_book_date_bex string"),
                  f"{root}/cust.csv", null_value="")
    counts = {(r.source, r.column_name, r.kind): r.n
              for r in jobs.ingest_job(spark, f"{root}/cust.csv", f"{root}/raw", f"{root}/cache").collect()}
    assert counts == {("transactions", "unit_count", "lost"): 1, ("transactions", "begin_use_date", "lost"): 1,
                      ("transactions", "gross_booking_amount_usd", "lost"): 1,
                      ("transactions", "gross_booking_amount_usd", "rounded"): 1, ("customers", "first_book_date_bex", "lost"): 1}
    cells = {(r.column_name, r.text) for r in spark.read.parquet(f"{root}/cache/faults").collect()}
    assert ("unit_count", "many") in cells and ("begin_use_date", "1998-13-05") in cells
    got = {r.booking_code: r.gbv for r in jobs.read_cache(spark, f"{root}/cache").tx.collect()}
    assert float(got["1"]) == 10.125  # finer than cents, kept
    assert got["4"] is None and csv.FAULTS not in jobs.read_cache(spark, f"{root}/cache").tx.columns


def test_run_id():
    import datetime as dt
    assert jobs.run_id("tier_expanded", dt.datetime(2024, 5, 6, 7, 8, 9)) == \
        "20240506---070809---segment-tier_expanded"


def test_command_line(spark, capsys):
    from waypoint.__main__ import main
    root = tempfile.mkdtemp(prefix="waypoint-cli-")
    tx = fx.tx_extract(spark, SF_SMALL)
    csv.write_csv(fx.customer_extract(spark, SF_SMALL), f"{root}/cust.csv", null_value="")
    csv.write_csv(tx, f"{root}/raw/all_tx1of1.csv", null_value="")
    csv.write_csv(fx.survey_map_extract(spark, SF_SMALL), f"{root}/map.csv", null_value="null")
    csv.write_csv(fx.alt_segments_extract(spark, SF_SMALL), f"{root}/alt.csv")
    label_columns(fx.survey_responses_extract(spark, SF_SMALL), QUESTION_LABELS) \
        .write.parquet(f"{root}/responses.parquet")
    main(["ingest", "--cust", f"{root}/cust.csv", "--tx", f"{root}/raw", "--cache", f"{root}/cache"])
    survey = ["--survey-cust", f"{root}/cust.csv", "--survey-tx", f"{root}/raw",
              "--survey-map", f"{root}/map.csv", "--responses", f"{root}/responses.parquet",
              "--year", "1998", "--out", f"{root}/out"]
    main(["model", "--cache", f"{root}/cache", "--alt", f"{root}/alt.csv", "--brand", "BR1",
          "--segmentation", "tier_expanded", "--default-segment", "Blue", "--unit-cap", "15",
          "--spend-step", "40000", "--spend-cap", "80000", *survey])
    main(["analyses", "--cache", f"{root}/cache", "--alt", f"{root}/alt.csv", "--brand", "BR1",
          "--segmentation", "tier_expanded", "--default-segment", "Blue", "--spend-step", "40000",
          "--spend-cap", "80000", "--only", "calculated_tier_counts", *survey])
    main(["respondents", *survey])
    printed = capsys.readouterr().out
    assert "bookings" in printed and "members" in printed and "join-data" in printed and "calculated_tier_counts" in printed
