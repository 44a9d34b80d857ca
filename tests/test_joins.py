"""Salted lookup join: same rows as the plain join, hot key spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from waypoint.operators.joins import hot_keys, lookup_join


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(5)
    fact = [(None if i % 3 == 0 else (1 if i % 3 == 1 and i % 2 else rnd.randrange(2, 400)),
             i, float(rnd.randrange(10))) for i in range(6000)]
    dim = [(None, "nullkey")] + [(k, f"d{k}") for k in range(1, 350)]
    return (spark.createDataFrame(fact, "k long, i long, v double"),
            spark.createDataFrame(dim, "k long, name string"))


def test_hot_keys_bounded_and_found(skewed):
    fact, _ = skewed
    hot = hot_keys(fact, "k", share=0.05)
    assert None in hot and 1 in hot and len(hot) <= 20


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_lookup_join_equals_plain_join(skewed, how, null_safe):
    fact, dim = skewed
    hot = hot_keys(fact, "k", share=0.05)
    got = lookup_join(fact, dim, "k", how, hot=hot, null_safe=null_safe, salts=7)
    plain = lookup_join(fact, dim, "k", how, hot=(), null_safe=null_safe)
    assert sorted(got.columns) == sorted(plain.columns)
    norm = lambda df: sorted(tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect())
    assert norm(got) == norm(plain)


def test_hot_key_spreads_over_partitions(skewed, spark):
    fact, dim = skewed
    hot = hot_keys(fact, "k", share=0.05)
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",
                                            "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lookup_join(fact, dim, "k", "inner", hot=hot, null_safe=True, salts=8)
        parts = (out.where(F.col("k").isNull()).select(F.spark_partition_id().alias("p"))
                 .distinct().count())
        plain = lookup_join(fact, dim, "k", "inner", hot=(), null_safe=True)
        plain_parts = (plain.where(F.col("k").isNull()).select(F.spark_partition_id().alias("p"))
                       .distinct().count())
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert plain_parts == 1 and parts > 1


def test_copies_of_a_hot_row_spread(spark):
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",
                                            "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = spark.createDataFrame([(1, 5)] * 3000 + [(k, 1) for k in range(2, 500)],
                                     "k long, v long").repartition(4)
        dim = spark.createDataFrame([(k, f"d{k}") for k in range(1, 500)], "k long, name string")
        sizes = {}
        for spread in (False, True):
            out = lookup_join(fact, dim, "k", "inner", hot=(1,), salts=8, spread_copies=spread)
            sizes[spread] = (max(out.rdd.glom().map(len).collect()), out.count())
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert sizes[False][1] == sizes[True][1] == 3000 + 498
    assert sizes[False][0] >= 3000 and sizes[True][0] < 1500
