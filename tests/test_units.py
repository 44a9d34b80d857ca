"""Booking table fill-and-cap rule and the simulator outputs on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from waypoint.operators import outputs as O
from waypoint.operators import units as U
from waypoint.params import ModelParams


def _running(spark):
    return spark.createDataFrame(
        [(1, 10, "A", 60.0, 1.0, dt.date(2024, 3, 1), False, 5.5, 50.0, 3.0)],
        "ccid long, booking_code long, segment string, trip_elements double, bookings double, "
        "begin_use_date date, is_package boolean, gbvlc double, "
        "trip_elements_start_of_booking double, bookings_start_of_booking double")


def test_fill_then_cap_only_unit_columns(spark):
    p = ModelParams(unit_cap=45, brand="X")
    cu = spark.createDataFrame([(1, 70.0, 2, None, None, None)],
                               "ccid long, trip_elements_current_year double, "
                               "bookings_current_year long, trip_elements_prev_year double, "
                               "bookings_prev_year long, trip_elements_prev_2_year double")
    wide = spark.createDataFrame([(10,)], "booking_code long").select(
        "booking_code", *[F.lit(99.0).alias(c) for c in U.wide_columns(p)])
    r = U.booking_units(_running(spark), cu, wide, p).first()
    assert r.trip_elements == 60.0                      # not capped
    assert r.trip_elements_start_of_booking == 45.0     # capped
    assert r.trip_elements_current_year == 45.0         # capped
    assert r.trip_elements_prev_year == 0.0             # filled
    assert r.bookings_prev_year == 0.0 and r.bookings_current_year == 2.0
    assert r.lob_trip_elements_air == 99.0              # lob_* not capped


def test_outputs_round_half_even_and_scale(spark):
    p = ModelParams(extract_fraction=0.4, brand="X")
    bu = spark.createDataFrame(
        [(1, "A", 1.0, 0.0, 2.0, 1.0, 0.0, 1.0, 1.0, True, 2.5)],
        "ccid long, segment string, bookings double, trip_elements_start_of_booking double, "
        "trip_elements_current_year double, trip_elements_prev_year double, "
        "bookings_start_of_booking double, bookings_current_year double, "
        "bookings_prev_year double, is_package boolean, gbvlc double")
    out = {r.unit_type: r for r in O.bookings_for_simulator(O.unit_views(bu), p).collect()}
    assert out["bookings"].bookings == 2.0              # 1 / 0.4 = 2.5 -> 2 (half-even)
    assert out["trip_elements"].units_earned_current_year == 2.0
    mem = {r.unit_type: r for r in O.members_for_simulator(
        bu.withColumn("trip_elements", F.lit(3.0)), p).collect()}
    assert mem["bookings"].num_members == 2.0 and mem["bookings"].gbvlc == 6.0  # 6.25 -> 6
    assert mem["bookings"].packages == 2.0


def test_shared_booking_code_gets_combined_lob_values(spark):
    p = ModelParams(brand="X")
    by_lob = spark.createDataFrame(
        [(1, 7, "A", 2024, "air", 2.0, 10.0, dt.date(2024, 1, 5)),
         (2, 7, "B", 2024, "air", 3.0, 5.0, dt.date(2024, 1, 6)),
         (2, 7, "B", 2024, "car", 1.0, 1.0, dt.date(2024, 1, 6))],
        "ccid long, booking_code long, segment string, use_year int, lob string, "
        "trip_elements double, gbvlc double, begin_use_date date")
    active = spark.createDataFrame([(1,), (2,)], "ccid long")
    packages = spark.createDataFrame([(7, True)], "booking_code long, is_package boolean")
    w = U.booking_lob_wide(by_lob, active, packages, p).first()
    assert w.lob_gbvlc_air_package == 15.0 and w.lob_gbvlc_car_package == 1.0
    assert w.lob_trip_elements_air_package == 5.0 and w.lob_gbvlc_air == 0.0
    assert w.lob_bookings_air_package == 1.0 and w.lob_bookings_lodging_package == 0.0
    bu = spark.createDataFrame([(1, 7), (2, 7)], "ccid long, booking_code long")
    r = U.shared_booking_codes(bu).first()
    assert (r.n_booking_codes, r.n_shared_codes, r.max_customers_per_code) == (1, 1, 2)
