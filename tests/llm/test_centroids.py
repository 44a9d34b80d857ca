"""Centroid clustering against a full search, its bounds, and its defined cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from waypoint.llm import centroids as C


def brute(rows, k=4, rounds=3, dim=4, scale=256, prefix="2:"):
    """(id, cluster, distance) of every kept row and the centroids, by plain Python."""
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
          if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{prefix}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cs = [v for _, v in sorted(ok, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        got = [(near(v)[1], v) for _, v in ok]
        cs = [[sum(col) // len(m) for col in zip(*m)] if (m := [v for n, v in got if n == c]) else old
              for c, old in enumerate(cs)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in ok), cs


def test_search_equals_full_search_and_rejects():
    rng = np.random.default_rng(1)
    for spread in (3, 200, 20_000):
        # centroids of many means; ties and copies among them
        cs = rng.integers(-spread, spread, (40, 8)) + rng.integers(-spread, spread, (40, 1))
        cs[7], cs[31] = cs[2], -cs[3]
        x = np.concatenate([rng.integers(-spread, spread, (500, 8)) + rng.integers(-spread, spread, (500, 1)), cs])
        best, dist, taken = C.Search(cs.tolist()).nearest(x)
        full = ((x[:, None] - cs[None]) ** 2).sum(axis=2)
        assert (best == full.argmin(axis=1)).all() and (dist == full.min(axis=1)).all()
        assert taken < full.size * 0.7


def test_wide_integers_are_exact():
    assert C.scaled(np.array([[1e30, -0.001]]), 256).tolist() == [[int(1e30) * 256, -1]]
    assert C.scaled(np.array([[-0.001, 3.999]]), 256).tolist() == [[-1, 1023]]
    cs = np.array([[10**6 + 1, 10**6], [10**6, 10**6], [10**6, 10**6 - 1]])  # sums large beside the deviations
    best, dist, _ = C.Search(cs.tolist()).nearest(cs[::-1].copy())
    assert best.tolist() == [2, 1, 0] and not dist.any()
    n = -(1 << 200) + 12345
    assert sum(v << (C.LIMB * i) for i, v in enumerate(C.limbs(n))) == n
    assert max(abs(v) for v in C.limbs(n)) < 1 << C.LIMB


def test_cluster_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(i % 3, 0.4) for _ in range(4)]) for i in range(200)]
    rows += [(5, rows[5][1]), (6, [9.0, 9.0, 9.0, 9.0]), (None, [0.1, 0.2, 0.3, 0.4]),  # repeated and null ids
             (900, None), (901, [1.0, 2.0]), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4),
             (904, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "vec_id long, embedding array<double>, cluster string, distance int").repartition(5)
    got, cs = C.cluster(df, k=4, rounds=3, dim=4)
    want, centers = brute(rows)
    assert cs == centers
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want


def test_huge_components_and_few_rows(spark):
    rows = [(1, [1e30, 0.0]), (2, [1e30, 1.0]), (3, [-3e38, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, cs = C.cluster(df, k=5, rounds=2, dim=2)
    assert len(cs) == 3
    want, centers = brute(rows, k=5, rounds=2, dim=2)
    assert cs == centers
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == [
        (i, c, min(d, C.LONG)) for i, c, d in want]


@pytest.mark.parametrize("parts", [1, 3])
def test_empty_tables(spark, tmp_path, parts):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int").repartition(parts)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = C.op11_centroids(spark, str(tmp_path))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert out.count() == 0
