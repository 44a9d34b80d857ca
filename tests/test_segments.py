"""Segmentation: weighted draw, guards, name cleaning, uniqueness, override."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from waypoint.operators import segments as S
from waypoint.params import ModelParams


def test_draw_follows_typing_shares(spark):
    n_ids = 30000
    segs = F.array(*[F.struct(F.lit(s).alias("segment_nm"), F.lit(n).cast("long").alias("n"),
                              F.lit(c).cast("long").alias("cum_n"))
                     for s, n, c in (("a", 1, 1), ("b", 2, 3), ("c", 7, 10))])
    cand = (spark.range(1, n_ids + 1).select(F.col("id").alias("ccid"), F.inline(segs))
            .withColumn("n_cell", F.lit(10).cast("long")))
    drawn = S.draw_segments(cand, seed=7)
    assert drawn.count() == n_ids
    assert drawn.select("ccid").distinct().count() == n_ids
    shares = {r.segment: r["count"] / n_ids for r in drawn.groupBy("segment").count().collect()}
    assert abs(shares["a"] - 0.1) < 0.01
    assert abs(shares["b"] - 0.2) < 0.01
    assert abs(shares["c"] - 0.7) < 0.01


def _tx(spark, rows):
    return spark.createDataFrame(
        [(c, dt.date(2024, 3, 1), lob, g) for c, lob, g in rows],
        "ccid long, begin_use_date date, lob string, gbv double")


def _typing(spark, rows):
    df = spark.createDataFrame(rows, "lob_air_gbv_cut double, lob_lodging_gbv_cut double, "
                                     "segment_nm string, n long")
    from pyspark.sql import Window
    cell = Window.partitionBy("lob_air_gbv_cut", "lob_lodging_gbv_cut")
    return df.select("*", (F.col("n") / F.sum("n").over(cell)).alias("segment_frac"),
                     F.sum("n").over(cell).alias("n_cell"),
                     F.sum("n").over(cell.orderBy("segment_nm")).alias("cum_n"))


def test_uncovered_cell_raises_and_default_fills(spark):
    p = ModelParams()
    tx = _tx(spark, [(1, "air", 500.0), (2, "air", 2500.0), (3, "car", 10.0)])
    answers = spark.createDataFrame([(9, "Low Frequency"), (9, "High Flight")],
                                    "ccid long, segments_v1 string")
    typing = _typing(spark, [(0.0, 0.0, "High Flight", 3)])
    with pytest.raises(ValueError, match="not placed"):
        S.get_segments(tx, typing, answers, p)
    seg = {r.ccid: r.segment for r in
           S.get_segments(tx, typing, answers, p.with_(on_uncovered="default")).collect()}
    assert seg == {1: "High Flight", 2: "Low Frequency", 3: "Low Frequency"}


def test_unknown_default_level_raises(spark):
    p = ModelParams(default_segment="Nope")
    tx = _tx(spark, [(1, "air", 500.0)])
    answers = spark.createDataFrame([(1, "High Flight")], "ccid long, segments_v1 string")
    with pytest.raises(ValueError, match="not in levels"):
        S.get_segments(tx, _typing(spark, [(0.0, 0.0, "High Flight", 1)]), answers, p)


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "a int, b int, c int, d int, e int").toDF(
        "CID External CID", "Tier Expanded", "Q1_Trips", "segmentsV1", "tier expanded")
    assert S.clean_names(df).columns == ["cid_external_cid", "tier_expanded", "q1_trips",
                                         "segments_v1", "tier_expanded_2"]


def test_unique_only_with_hot_key(spark):
    rows = [(1, "x")] * 500 + [(2, "y"), (3, "z"), (3, "z")]
    df = spark.createDataFrame(rows, "ccid long, s string")
    assert sorted(tuple(r) for r in S.unique_only(df, "ccid").collect()) == [(2, "y")]


def test_override_rejects_unknown_segmentation(spark):
    answers = spark.createDataFrame([("S1", "A", 1)], "cid_external string, segments_v1 string, ccid long")
    alt = spark.createDataFrame([("S1", "Blue")], "`CID External CID` string, `Tier Expanded` string")
    ids = spark.createDataFrame([(1, "S1")], "ccid long, cid string")
    with pytest.raises(ValueError, match="not a valid selection"):
        S.override_segmentation(answers, alt, ids, "segments_v9")
    out = S.override_segmentation(answers, alt, ids, "tier_expanded").collect()
    assert [(r.ccid, r.segments_v1) for r in out] == [(1, "Blue")]
