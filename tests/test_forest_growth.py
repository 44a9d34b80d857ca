"""The forest grown as a Spark job: no tree in the driver or a task, the same votes wherever a node is split."""

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from waypoint.operators import forest
from waypoint.params import fixture_params

P = fixture_params().with_(forest_trees=15)
NAMES = [f"lob_{x}" for x in P.forest_lobs]


@pytest.fixture(scope="module")
def tables(spark):
    rnd = np.random.default_rng(5)
    x = np.round(rnd.random((600, 5)) * 1000, 1)
    seg = np.array(["A", "B", "C"])[(x[:, 0] > 500).astype(int) + (x[:, 1] > x[:, 2] + 300)]
    train = spark.createDataFrame([(*map(float, r), s) for r, s in zip(x, seg.tolist())], [*NAMES, "segments_v1"])
    score = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["ccid", *NAMES])
    return train, score, seg


def test_votes_are_the_same_wherever_nodes_are_split(spark, tables):
    train, score, seg = tables
    votes = {}
    for bound in (10_000, 40):  # all in tasks; the upper levels by Spark
        got, labels = forest.forest_votes(train, score, P, local_rows=bound)
        votes[bound] = {r.ccid: list(r.votes) for r in got.collect()}
    assert votes[10_000] == votes[40] and len(votes[40]) == 600
    assert all(sum(v) == pytest.approx(P.forest_trees) for v in votes[40].values())
    assert np.mean([labels[int(np.argmax(votes[40][i]))] == s for i, s in enumerate(seg)]) > 0.9
    # as good as the library's forest on the same rows
    nodes, names = forest.forest_nodes(forest.fit_forest(train, P))
    assert names == labels
    library = {r.ccid: r.pred_class for r in forest.predictions(nodes, names, score, P).collect()}
    mine = {i: labels[int(np.argmax(v))] for i, v in votes[40].items()}
    assert np.mean([library[i] == mine[i] for i in mine]) > 0.95


def test_a_tree_is_grown_to_pure_leaves(spark):
    """Without a draw every row reaches a leaf of its own class; depth and equal rows end a branch."""
    x = np.array([[i % 8, i // 8, 0] for i in range(64)])
    y = np.array([(i * 7) % 3 for i in range(64)])
    p = P.with_(forest_features_per_split=2)
    out = forest.grow(0, 1, x, y, np.ones(64), x, 3, 8, p.with_(forest_features_per_split=3))
    assert (out.argmax(axis=1) == y).all() and (out.max(axis=1) == 1).all()
    flat = forest.grow(0, 1, x, y, np.ones(64), x, 3, 8, p.with_(forest_depth=0))
    assert np.allclose(flat, np.bincount(y) / 64)
    same = forest.grow(0, 1, np.zeros((4, 3), int), np.array([0, 0, 1, 2]), np.ones(4), np.zeros((1, 3), int), 3, 8, p)
    assert same.tolist() == [[0.5, 0.25, 0.25]]


def test_missing_spend_is_refused_in_training(spark, tables):
    train, score, _ = tables
    from pyspark.sql import functions as F
    with pytest.raises(Exception, match="missing spend"):
        forest.forest_votes(train.withColumn(NAMES[0], F.lit(None).cast("double")), score, P)
    # a scored customer's goes right at every split, as before
    got, _ = forest.forest_votes(train, score.withColumn(NAMES[0], F.lit(None).cast("double")), P)
    top, _ = forest.forest_votes(train, score.withColumn(NAMES[0], F.lit(1e9)), P)
    assert sorted(tuple(r.votes) for r in got.collect()) == sorted(tuple(r.votes) for r in top.collect())


def test_query_keeps_no_tree_in_the_driver(spark, monkeypatch):
    from waypoint.plans.registry import QUERIES

    def must_not(*args):
        raise AssertionError("all trees in the driver")

    monkeypatch.setattr(forest, "fit_forest", must_not)
    monkeypatch.setattr(forest, "forest_nodes", must_not)
    n = QUERIES["rf_scored_customers"](spark, SF_SMALL).count()
    rows = QUERIES["rf_predicted_counts"](spark, SF_SMALL).collect()
    assert sum(r.n for r in rows) == n and len({r.pred_class for r in rows}) == len(rows) > 1
