"""Range-partitioned ordered operators against brute force, with a hot key."""

import random

import pandas as pd

from waypoint.operators.ordered import dense_ids, exclusive_running_totals


def test_dense_ids_equal_global_row_number(spark):
    rnd = random.Random(3)
    keys = [f"k{rnd.randrange(10**6):07d}" for _ in range(3000)] + [None, None]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)
    got = {r.k: r.ccid for r in dense_ids(df, "k", num_partitions=7).collect()}
    want = sorted(set(keys), key=lambda v: (v is not None, v or ""))
    assert got == {k: i + 1 for i, k in enumerate(want)}


def _brute(pdf, key, order, val):
    pdf = pdf.sort_values([key] + order, kind="mergesort")
    g = pdf.groupby(key)[val]
    pdf["before"] = g.cumsum() - pdf[val]
    pdf["n_before"] = pdf.groupby(key).cumcount()
    return pdf


def test_running_totals_hot_key_across_partitions(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(4000):
        # one customer holds a third of all rows
        c = 1 if i % 3 == 0 else rnd.randrange(2, 300)
        rows.append((c, rnd.randrange(0, 60), i, float(rnd.randrange(1, 9))))
    df = spark.createDataFrame(rows, "ccid long, day int, code long, te double")
    out = exclusive_running_totals(df, "ccid", ["day", "code"], {"before": "te"},
                                   count_out="n_before", num_partitions=9)
    got = out.toPandas().sort_values(["ccid", "day", "code"]).reset_index(drop=True)
    want = _brute(pd.DataFrame(rows, columns=["ccid", "day", "code", "te"]),
                  "ccid", ["day", "code"], "te").reset_index(drop=True)
    assert (got["before"].values == want["before"].values).all()
    assert (got["n_before"].values == want["n_before"].values).all()


def test_running_totals_rows_frame_on_same_day(spark):
    df = spark.createDataFrame([(1, 5, 2, 3.0), (1, 5, 1, 4.0), (1, 6, 0, 1.0)],
                               "ccid long, day int, code long, te double")
    out = {r.code: (r.before, r.n) for r in exclusive_running_totals(
        df, "ccid", ["day", "code"], {"before": "te"}, count_out="n").collect()}
    assert out == {1: (0.0, 0), 2: (4.0, 1), 0: (7.0, 2)}


def test_missing_order_values_come_last(spark):
    rows = [(1, "1998-01-01", None, 4.0), (1, "1998-01-01", 9, 2.0), (1, "1998-01-02", 5, 1.0), (2, None, 1, 3.0), (2, "1998-05-01", 2, 8.0)]
    df = spark.createDataFrame(rows, "ccid long, d string, code long, u double")
    for n in (1, 3):
        got = {(r.ccid, r.code): (r.before, r.k) for r in exclusive_running_totals(
            df, "ccid", ["d", "code"], {"before": "u"}, count_out="k", num_partitions=n).collect()}
        assert got == {(1, 9): (0, 0), (1, None): (2, 1), (1, 5): (6, 2), (2, 2): (0, 0), (2, 1): (8, 1)}
