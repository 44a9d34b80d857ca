"""Segment prediction with a random forest on LOB spend.

``forest_votes`` grows the forest as a Spark job: the (binned) training rows of
all trees are one table, each tree with its own draw of them. Nodes of many
rows are split level by level from histograms that Spark adds up; a node of at
most ``LOCAL_ROWS`` different rows is grown to its leaves by the task that holds
its rows. Customers to be scored walk along as rows without weight, so no tree
is ever held whole, neither by the driver nor by a task.

``fit_forest``, ``forest_nodes`` and ``votes`` are the same method with the
library's trainer, which holds all trees in the driver: for forests of few nodes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.functions.kernel import filled_sum
from waypoint.operators.lines import year_slice
from waypoint.params import ModelParams
from waypoint.session import materialize, scratch_path

#: Values of a binned feature; different training rows of a node that one task grows, and nodes it splits at a time.
BINS, LOCAL_ROWS, AT_ONCE = 32, 50_000, 2048


def lob_spend_wide(tx: DataFrame, p: ModelParams) -> DataFrame:
    """Per customer: analysis-year spend per forest LOB, missing 0, as doubles."""
    y = year_slice(tx, p.analysis_year)
    return y.groupBy("ccid").agg(*[
        filled_sum("gbv", F.col("lob") == l).cast("double").alias(f"lob_{l}")
        for l in p.forest_lobs])


def training_set(survey_tx: DataFrame, answers: DataFrame, p: ModelParams) -> DataFrame:
    """Spend features of respondents with their survey segment (label present)."""
    y = answers.select("ccid", "segments_v1")
    return (lob_spend_wide(survey_tx, p).join(y, "ccid")
            .where(F.col("segments_v1").isNotNull()).drop("ccid"))


def fit_forest(train: DataFrame, p: ModelParams):
    """Fit label index + assembler + forest; returns (model, labels).

    Spark ML tests up to 32 split points per feature and stops at depth 30;
    otherwise trees grow until their leaves are pure or hold one row.
    """
    feats = [f"lob_{l}" for l in p.forest_lobs]
    idx = StringIndexer(inputCol="segments_v1", outputCol="label").fit(train)
    rf = RandomForestClassifier(numTrees=p.forest_trees, seed=p.seed, labelCol="label",
                                featuresCol="features", maxDepth=p.forest_depth,
                                minInstancesPerNode=p.forest_min_node,
                                featureSubsetStrategy=str(p.forest_features_per_split))
    model = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features"),
                             rf]).fit(idx.transform(train))
    return model, list(idx.labels)


def forest_nodes(fitted) -> tuple[DataFrame, list[str]]:
    """(tree, nodes) rows of a fitted forest, and its labels: the trees as data.

    ``nodes`` is an array by node id of (feature, threshold, left, right, votes): a
    leaf has feature -1, and its votes are the shares of the classes among its
    training rows. Read from the forest's saved form, which is a table.
    """
    model, labels = fitted
    spark = SparkSession.active()
    path = scratch_path(spark, "forest")
    model.stages[-1].write().save(path)
    node = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    stats = F.col("impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    rows = node.select("tree", F.struct(
        "id", F.when(F.col("leftChild") < 0, F.lit(-1)).otherwise(F.col("split.featureIndex")).alias("feature"),
        F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.when(F.col("leftChild") < 0, F.transform(stats, lambda x: x / total)).alias("votes")).alias("node"))
    return materialize(rows.groupBy("tree").agg(F.array_sort(F.collect_list("node")).alias("nodes")), "forest-nodes"), labels


def votes(nodes: DataFrame, score: DataFrame, p: ModelParams) -> DataFrame:
    """(ccid, votes): for each customer of ``score`` the sum of the trees' leaf votes by class.

    A customer meets every tree (``forest_trees`` rows, broadcast) and walks down
    it by a native expression over the tree's node array, a step a level.
    """
    x = F.array(*[F.col(f"lob_{l}") for l in p.forest_lobs])
    at = lambda i: F.get(F.col("nodes"), i)
    step = lambda i, _: F.when(at(i)["feature"] < 0, i).when(
        F.get(F.col("x"), at(i)["feature"]) <= at(i)["threshold"], at(i)["left"]).otherwise(at(i)["right"])
    leaf = F.aggregate(F.sequence(F.lit(1), F.lit(p.forest_depth)), F.lit(0), step)
    trees = [r["tree"] for r in nodes.select("tree").collect()]  # forest_trees numbers
    met = (score.select("ccid", x.alias("x")).withColumn("tree", F.explode(F.array(*[F.lit(t) for t in sorted(trees)])))
           .join(F.broadcast(nodes), "tree").select("ccid", "tree", at(leaf)["votes"].alias("v")))
    return summed_votes(met)


def summed_votes(met: DataFrame) -> DataFrame:
    """(ccid, votes) from a row (ccid, tree, v) a customer and tree."""
    by_class = met.select("ccid", "tree", F.posexplode("v").alias("c", "v"))
    # a sum in tree order, so that ties are the same in every run
    summed = (by_class.groupBy("ccid", "c").agg(F.array_sort(F.collect_list(F.struct("tree", "v"))).alias("vs"))
              .select("ccid", "c", F.aggregate("vs", F.lit(0.0), lambda a, s: a + s["v"]).alias("n")))
    return summed.groupBy("ccid").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "n"))), lambda s: s["n"]).alias("votes"))


def predictions(nodes: DataFrame, labels: list[str], score: DataFrame, p: ModelParams) -> DataFrame:
    """(ccid, pred_class): the class of most votes, the first of equals."""
    return classes(votes(nodes, score, p), labels)


def classes(votes: DataFrame, labels: list[str]) -> DataFrame:
    """(ccid, pred_class): the class of most votes, the first of equals."""
    best = F.array_position("votes", F.array_max("votes")) - 1
    return votes.select(
        "ccid", F.get(F.array(*[F.lit(x) for x in labels]), best.cast("int")).alias("pred_class"))


def split_points(train: DataFrame, features: list[str]) -> list[list[float]]:
    """Up to ``BINS - 1`` thresholds a feature, between neighbouring values: all of them for few values,
    else those after the quantiles."""
    few = {f: sorted(r[0] for r in train.where(F.col(f).isNotNull()).select(f).distinct().limit(BINS + 1).collect()) for f in features}
    many = [f for f in features if len(few[f]) > BINS]
    at = [i / BINS for i in range(1, BINS)]
    low = train.agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in many]).first() if many else {}
    low = {f: sorted(set(low[f])) for f in many}
    above = train.agg(*[F.array(*[F.min(F.when(F.col(f) > x, F.col(f))) for x in low[f]]).alias(f) for f in many]).first() if many else {}
    pairs = {f: zip(low[f], above[f]) if f in low else zip(few[f], few[f][1:]) for f in features}
    return [[(a + b) / 2 for a, b in pairs[f] if b is not None] for f in features]


def binned(feature: str, points: list[float], missing: Column) -> Column:
    """How many thresholds lie below the value."""
    x = F.col(feature)
    below = F.size(F.filter(F.array(*[F.lit(float(t)) for t in points]), lambda t: x > t)) if points else F.lit(0)
    return F.when(x.isNull(), missing).otherwise(below).cast("int")


def drawn_features(seed: int, tree: int, nodes: np.ndarray, features: int, take: int) -> np.ndarray:
    """The features that each node tries, ascending: a draw without replacement by a hash of seed, tree and node."""
    mask = (1 << 64) - 1
    with np.errstate(over="ignore"):
        z = nodes.astype(np.uint64)[:, None] * np.uint64(features) + np.arange(features, dtype=np.uint64)
        z = z * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + (tree + 1) * 0x8CB92BA72F3D8DD7) & mask)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return np.sort(np.argsort(z, axis=1, kind="stable")[:, :take], axis=1)


def best_splits(hist: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the tried features, last bin of the left side) of the largest Gini gain of each node, the first of
    equals, from weights [node, tried feature, bin, class]; -1 for a node that no split makes purer."""
    left = hist.cumsum(axis=2)[:, :, :-1].astype(float)
    total = hist[:, :1].sum(axis=2, keepdims=True).astype(float)
    right = total - left
    n_left, n_right, n = left.sum(axis=-1), right.sum(axis=-1), np.maximum(total.sum(axis=-1), 1)
    square = lambda x, k: (x * x).sum(axis=-1) / np.maximum(k, 1)
    gain = (square(left, n_left) + square(right, n_right) - square(total, n)) / n
    gain = np.where((n_left >= max(least, 1)) & (n_right >= max(least, 1)), gain, -1).reshape(len(hist), -1)
    best = gain.argmax(axis=1) if gain.shape[1] else np.zeros(len(hist), int)
    none = gain[np.arange(len(hist)), best] <= 1e-14 if gain.shape[1] else np.ones(len(hist), bool)
    tried, last = np.divmod(best, max(left.shape[2], 1))
    return np.where(none, -1, tried), last


def shares(weights: np.ndarray) -> np.ndarray:
    return weights / np.maximum(weights.sum(axis=-1, keepdims=True), 1)


def grow(tree: int, node: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, score: np.ndarray, n_classes: int, n_bins: int,
         p: ModelParams) -> np.ndarray:
    """Class shares in the leaf that each row of ``score`` reaches in the subtree of ``node``, which is grown from its
    training rows (bins, class, weight) until its leaves are pure, cannot be split, or lie at the depth bound."""
    nodes, level = np.array([node], np.int64), int(node).bit_length() - 1
    at, s_at, s_row = np.zeros(len(y), np.int64), np.zeros(len(score), np.int64), np.arange(len(score))
    out = np.zeros((len(score), n_classes))
    while len(nodes):
        k = len(nodes)
        totals = np.bincount(at * n_classes + y, w, k * n_classes).reshape(k, n_classes)
        feature, last = np.full(k, -1), np.zeros(k, np.int64)
        if level < p.forest_depth:
            tried = drawn_features(p.seed, tree, nodes, x.shape[1], p.forest_features_per_split)
            for lo in range(0, k, AT_ONCE):
                part = tried[lo:lo + AT_ONCE]
                rows = slice(*np.searchsorted(at, [lo, lo + len(part)]))  # rows are in the order of their nodes
                own, m = at[rows] - lo, part.shape[1]
                cell = [((own * m + j) * n_bins + x[rows][np.arange(len(own)), part[own, j]]) * n_classes + y[rows] for j in range(m)]
                hist = np.bincount(np.concatenate(cell), np.tile(w[rows], m), len(part) * m * n_bins * n_classes)
                which, last[lo:lo + len(part)] = best_splits(hist.reshape(len(part), m, n_bins, n_classes), p.forest_min_node)
                feature[lo:lo + len(part)] = np.where(which < 0, -1, part[np.arange(len(part)), which])
        leaf = feature < 0
        ends = leaf[s_at]
        out[s_row[ends]] = shares(totals)[s_at[ends]]
        rank = np.cumsum(~leaf) - 1
        go, s_go = ~leaf[at], ~ends
        x, y, w, at = x[go], y[go], w[go], at[go]
        at = 2 * rank[at] + (x[np.arange(len(at)), feature[at]] > last[at])
        order = np.argsort(at, kind="stable")
        x, y, w, at = x[order], y[order], w[order], at[order]
        score, s_row, s_at = score[s_go], s_row[s_go], s_at[s_go]
        s_at = 2 * rank[s_at] + (score[np.arange(len(s_at)), feature[s_at]] > last[s_at])
        nodes, level = np.stack([2 * nodes[~leaf], 2 * nodes[~leaf] + 1], axis=1).ravel(), level + 1
    return out


def _rows(train: DataFrame, score: DataFrame, labels: list[str], p: ModelParams) -> tuple[DataFrame, list[str], int]:
    """The rows of all trees (tree, node, bins, label, w, ccid), their bins' columns, and how many bins there are:
    each tree's draw of the training rows, and every scored customer with weight 0."""
    features = [f"lob_{x}" for x in p.forest_lobs]
    points, xs = split_points(train, features), [f"x{i}" for i in range(len(features))]
    error = F.raise_error(F.lit("missing spend in the training set"))
    bins = lambda missing: [binned(f, t, missing(t)).alias(x) for f, t, x in zip(features, points, xs)]
    label = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("segments_v1")).cast("int") - 1
    # rows alike go together; a draw of n of them is one Poisson number of mean n
    counted = train.select(*bins(lambda t: error), label.alias("label")).groupBy(*xs, "label").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("h", F.xxhash64(*xs, "label"))
    seed, trees = p.seed, p.forest_trees

    def draw(batches):
        for b in batches:
            w = np.array([np.random.default_rng([seed & 0xFFFFFFFF, h & 0xFFFFFFFFFFFFFFFF]).poisson(n, trees)
                          for h, n in zip(b["h"].tolist(), b["n"].tolist())], np.int64).reshape(len(b), trees)
            row, tree = np.nonzero(w)
            out = b[[*xs, "label"]].iloc[row].reset_index(drop=True)
            yield out.assign(tree=tree.astype(np.int32), w=w[row, tree])

    kinds = ", ".join(f"{x} int" for x in xs)
    drawn = counted.mapInPandas(draw, f"{kinds}, label int, tree int, w long")
    drawn = drawn.select("tree", F.lit(1).cast("long").alias("node"), *xs, "label", "w", F.lit(None).cast("long").alias("ccid"))
    asked = score.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"),
                         *bins(lambda t: F.lit(len(t))), F.lit(-1).alias("label"), F.lit(0).cast("long").alias("w"),
                         F.col("ccid").cast("long").alias("ccid"))
    return materialize(drawn.unionByName(asked), "forest-rows"), xs, max(map(len, points)) + 1


def forest_votes(train: DataFrame, score: DataFrame, p: ModelParams, local_rows: int = LOCAL_ROWS) -> tuple[DataFrame, list[str]]:
    """(ccid, votes) of the customers of ``score``: the sums of the trees' leaf shares by class, and the classes by
    falling number of training rows (then by name)."""
    train = materialize(train, "forest-training")
    found = train.groupBy("segments_v1").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a segment
    labels = [r["segments_v1"] for r in sorted(found, key=lambda r: (-r["n"], r["segments_v1"]))]
    if not labels:
        raise ValueError("no respondents to learn from")
    todo, xs, n_bins = _rows(train, score, labels, p)
    key, n_classes = ["tree", "node"], len(labels)
    small, ended = [], []
    best = _best_of_node(xs, n_classes, n_bins, p)
    while True:  # a level of the nodes that are too large for a task
        sizes = todo.where("label >= 0").groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
        large = materialize(sizes.where(F.col("rows") > local_rows).select(*key), "forest-large")  # rows / local_rows at most
        if large.isEmpty():
            small.append(todo)
            break
        small.append(todo.join(F.broadcast(large), key, "left_anti"))
        rows = todo.join(F.broadcast(large), key)
        cells = (rows.where("label >= 0").select(*key, "label", "w", F.posexplode(F.array(*xs)).alias("feature", "bin"))
                 .groupBy(*key, "feature", "bin", "label").agg(F.sum("w").alias("w")))
        splits = materialize(cells.groupBy(*key).applyInPandas(
            best, "tree int, node long, feature int, last int, v array<double>"), "forest-splits")
        split = rows.join(F.broadcast(splits), key)
        ended.append(split.where("feature < 0 AND label < 0").select("ccid", "tree", "v"))
        right = (F.get(F.array(*xs), F.col("feature")) > F.col("last")).cast("long")
        todo = materialize(split.where("feature >= 0").select(
            "tree", (F.col("node") * 2 + right).alias("node"), *xs, "label", "w", "ccid"), "forest-rows")

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        known = (pdf["label"] >= 0).to_numpy()
        x, tree = pdf[xs].to_numpy(np.int64), int(pdf["tree"].iloc[0])
        v = grow(tree, int(pdf["node"].iloc[0]), x[known], pdf["label"].to_numpy(np.int64)[known],
                 pdf["w"].to_numpy(float)[known], x[~known], n_classes, n_bins, p)
        return pd.DataFrame({"ccid": pdf["ccid"].to_numpy()[~known].astype(np.int64), "tree": np.int32(tree), "v": list(v)})

    tasks = max(p.forest_trees, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    local = (reduce(DataFrame.unionByName, small).repartition(tasks, *key).groupBy(*key)
             .applyInPandas(grown, "ccid long, tree int, v array<double>"))
    # written once: the growth is not repeated by a second reader
    return summed_votes(materialize(reduce(DataFrame.unionByName, [local, *ended]), "forest-votes")), labels


def _best_of_node(xs: list[str], n_classes: int, n_bins: int, p: ModelParams) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The split of one node from its histogram's cells, or the shares of a leaf."""
    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        hist = np.zeros((len(xs), n_bins, n_classes))
        hist[pdf["feature"], pdf["bin"], pdf["label"]] = pdf["w"]
        tried = drawn_features(p.seed, tree, np.array([node]), len(xs), p.forest_features_per_split)[0]
        which, last = best_splits(hist[None, tried], p.forest_min_node) if node.bit_length() <= p.forest_depth else ([-1], [0])
        feature = -1 if which[0] < 0 else int(tried[which[0]])
        return pd.DataFrame({"tree": [tree], "node": [node], "feature": [feature], "last": [int(last[0])],
                             "v": [shares(hist[0].sum(axis=0)).tolist()]})
    return best


def predicted_counts(predicted: DataFrame) -> DataFrame:
    """Predicted class per scored customer, counted per class."""
    return predicted.groupBy("pred_class").agg(F.count(F.lit(1)).alias("n"))
