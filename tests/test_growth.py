"""Bucketed multipliers without a global sort vs the reference's row-level algorithm."""

import math
import random

import pytest

from waypoint.operators.transitions import growth_multipliers
from waypoint.params import ModelParams


def brute(values, k):
    v = sorted(values)
    n = len(v)
    groups = {}
    for i, x in enumerate(v, start=1):
        g = math.floor(((i - 1) / n) * k) / k
        groups.setdefault(g, []).append(x)
    mean = sum(v) / n
    return {g: (sum(xs) / len(xs), (sum(xs) / len(xs)) / mean) for g, xs in groups.items()}


@pytest.mark.parametrize("n,k,seed", [(7, 5, 1), (10, 3, 2), (101, 3, 3), (997, 4, 4), (1500, 10, 5)])
def test_growth_multipliers_match_row_algorithm(spark, n, k, seed):
    rnd = random.Random(seed)
    values = [float(rnd.choice([2, 3, 3, 4, 5, 8, 8, 8, 13, 21])) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "trip_elements_current_year double")
    got = {r.percentile_group: (r.group_mean_trip_elements, r.group_multiplier)
           for r in growth_multipliers(df, ModelParams(num_buckets=k)).collect()}
    want = brute(values, k)
    assert set(got) == set(want)
    for g in want:
        assert got[g][0] == pytest.approx(want[g][0], rel=1e-12)
        assert got[g][1] == pytest.approx(want[g][1], rel=1e-12)


def test_multiplier_identity(spark):
    values = [float(x) for x in (2, 2, 3, 5, 8, 13, 13, 21, 34)]
    df = spark.createDataFrame([(v,) for v in values], "trip_elements_current_year double")
    rows = growth_multipliers(df, ModelParams(num_buckets=3)).collect()
    brute_groups = brute(values, 3)
    sizes = {g: 0 for g in brute_groups}
    for i in range(len(values)):
        sizes[math.floor((i / len(values)) * 3) / 3] += 1
    mean = sum(values) / len(values)
    back = sum(r.group_multiplier * mean * sizes[r.percentile_group] for r in rows) / len(values)
    assert back == pytest.approx(mean)
