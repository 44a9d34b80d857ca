"""Null semantics and expression helpers (traps T1-T3, T5, T6, T10, T11)."""

import duckdb
from pyspark.sql import functions as F

from waypoint.functions import kernel as K
from waypoint.functions.tiers import calculated_tier_code, int_to_tier, named_tier


def test_null_safe_join_matches_nulls(spark):
    left = spark.createDataFrame([("a",), (None,), (None,)], "k string")
    right = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    assert K.null_safe_join(left, right, "k").count() == 5
    assert left.join(right, "k").count() == 1


def test_n_distinct_counts_null_once(spark):
    df = spark.createDataFrame([(1, "x"), (1, None), (1, None), (1, "y")], "g int, v string")
    assert df.groupBy("g").agg(K.n_distinct_na("v").alias("n")).first().n == 3


def test_strict_sum_and_min_propagate_null(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0), (2, 3.0)], "g int, v double")
    r = {x.g: (x.s, x.m) for x in df.groupBy("g").agg(
        K.strict_sum("v").alias("s"), K.strict_min("v").alias("m")).collect()}
    assert r[1] == (None, None)
    assert r[2] == (5.0, 2.0)


def test_filled_sum_zero_when_absent_null_when_na(spark):
    df = spark.createDataFrame([(1, "air", 1.0), (1, "car", None), (2, "air", 4.0)],
                               "g int, lob string, v double")
    r = {x.g: (x.air, x.car, x.lodging) for x in df.groupBy("g").agg(
        *[K.filled_sum("v", F.col("lob") == l).alias(l) for l in ("air", "car", "lodging")]
    ).collect()}
    assert r[1] == (1.0, None, 0)
    assert r[2] == (4.0, 0, 0)


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r.y for r in df.select(K.round_half_even("x").alias("y")).collect()] == [0, 2, 2, 0]


def test_pmax_propagates_null(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 3.0)], "a double, b double")
    assert [r.m for r in df.select(K.pmax_na("a", "b").alias("m")).collect()] == [None, 3.0]


def test_text_year_bad_input_is_null(spark):
    df = spark.createDataFrame([("2020-05-01",), ("null",), ("junk",)], "d string")
    assert [r.y for r in df.select(K.text_year("d").alias("y")).collect()] == [2020, None, None]


def test_spend_cut(spark):
    df = spark.createDataFrame([(0.0,), (999.99,), (1000.0,), (7999.0,), (8000.5,)], "x double")
    got = [r.c for r in df.select(K.spend_cut("x", 1000, 8000).alias("c")).collect()]
    assert got == [0.0, 0.0, 1000.0, 7000.0, 8000.0]


def test_hash52_matches_duckdb(spark):
    ids = list(range(1, 40)) + [123456789]
    got = {r.i: r.h for r in spark.createDataFrame([(i,) for i in ids], "i long")
           .select("i", K.hash52(7, F.col("i")).alias("h")).collect()}
    con = duckdb.connect()
    for i in ids:
        want = con.execute(
            f"SELECT ('0x' || substr(md5('7:' || CAST({i} AS VARCHAR)), 1, 13))::BIGINT").fetchone()[0]
        assert got[i] == want
    assert got[12] == 3697532221129180


def test_year_filter_prunes_and_matches(spark):
    df = spark.createDataFrame([("2019-12-31",), ("2020-01-01",), ("2020-12-31",), ("2021-01-01",)],
                               "d string").select(F.to_date("d").alias("begin_use_date"))
    assert df.where(K.year_filter(df, 2020)).count() == 2


def test_share_of_total(spark):
    df = spark.createDataFrame([(1, 1), (2, 3)], "k int, n long")
    assert [r.p for r in df.select(K.share_of_total(df, "n").alias("p")).orderBy("p").collect()] \
        == [0.25, 0.75]


def test_tier_helpers(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1), (5.0, None, 2), (14.0, 31.0, 5), (None, 15.0, 4)],
                               "s double, p double, code int")
    r = df.select(calculated_tier_code("s").alias("c"), named_tier("s", "p").alias("t"),
                  int_to_tier("code").alias("n")).collect()
    assert [x.c for x in r] == [1, 2, 2, None]
    assert [x.t for x in r] == ["blue", "silver", "platinum", "gold"]
    assert [x.n for x in r] == ["Blue", "Silver", "Platinum", None]
