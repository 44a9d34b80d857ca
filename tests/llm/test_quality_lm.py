import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypoint.llm import classlm, quality

SF1 = "/root/testdata/sf0.01"


def test_discriminant_equals_density_ratio(spark):
    rng = np.random.default_rng(4)
    d = len(quality.STATISTICS)
    mix = [rng.normal(size=(d, d)) for _ in range(2)]
    x = [rng.normal(size=(300, d)) @ mix[c] + c for c in range(2)]
    rows = [(c, [float(v) for v in r]) for c in range(2) for r in x[c][:200 + 100 * c]]
    model = quality.fit(spark.createDataFrame(rows, "label int, stats array<double>"))
    n = [200, 300]
    own = [np.cov(x[c][:n[c]].T, bias=True) for c in range(2)]
    common = (n[0] * own[0] + n[1] * own[1]) / 500
    logs = []
    for c in range(2):
        cov = 0.9 * own[c] + 0.1 * common
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-4 * np.eye(d)
        diff = x[0] - x[c][:n[c]].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1])
    z = math.log(301 / 201) + logs[1] - logs[0]
    assert model.scores(x[0]) == pytest.approx(1 / (1 + np.exp(-np.clip(z / d, -30, 30))))


def test_held_out_accuracy(spark, rows):
    labels = dict(rows("labels", "doc_id, quality", SF1))
    got = [r for r in quality.op5_quality(spark, SF1).collect()]
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert right >= 0.97 * len(held)
    good = [r.predicted for r in held if labels[r.doc_id] == 1]
    assert sum(good) >= 0.98 * len(good)


def test_labels_only_teach(spark, rows):
    """Held-out labels change nothing."""
    docs = spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.scored(docs, labels, teach=~held).collect()}
    b = {r.doc_id: r.score for r in quality.scored(docs, turned, teach=~held).collect()}
    assert a == pytest.approx(b)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (10, 0), (10, 1), (None, 0), (4, None)], "doc_id long, quality int")
    got = quality.scored(odd_docs, labels)
    assert got.count() == odd_docs.count()
    assert {r.score for r in got.collect()} != {None}
    assert quality.accepted(odd_docs, labels).columns == odd_docs.columns
    assert quality.scored(no_docs, labels).count() == 0
    none = quality.scored(odd_docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}


def test_class_lm_base_scores(spark, rows):
    docs = rows("documents", "doc_id, coalesce(text, '')")
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    words = {d: t.encode().lower().split() for d, t in docs}
    seen, ends = Counter(), 0
    for d, w in words.items():
        if not held(d):
            seen.update(w)
            ends += 1
    n, v = sum(seen.values()) + ends, len(seen) + 1
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    # a small table of known words sends most through the join
    for known in (300, classlm.KNOWN):
        df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
        got = classlm.scores(df, classlm.crc_mod("doc_id", 10) == 0, clustered=100, classes=8, known_words=known).collect()
        assert len(got) == len(docs)
        for r in got:
            w = words[r.doc_id]
            assert r.held_out == held(r.doc_id) and r.train_tokens == n and r.n_tokens == len(w) + 1
            assert r.n_known == sum(seen[x] > 0 for x in w) + 1
            assert r.base_score == pytest.approx(sum(log(seen[x]) for x in w) + log(ends), rel=1e-9)
            assert r.score < 0


def test_class_lm_is_a_distribution_and_beats_unigrams(spark):
    got = classlm.op7_class_lm(spark, SF1).toPandas()
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_emissions_and_transitions_add_up(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b c.", "b a d", "", "a Étude"] * 3)], "doc_id long, text string")
    vocabulary = classlm.word_counts(docs).cache()
    known, _ = classlm.frequent(vocabulary, 100)
    model = classlm.class_model(docs, vocabulary, known, clustered=3, classes=2)
    assert np.allclose((10 ** model["trans"]).sum(axis=1), 1)
    total = Counter()
    for c, n in zip(model["cls"], model["n"]):
        total[int(c)] += (n + classlm.ALPHA) / 10 ** model["divisor"][c]
    # what is left of a class is the mass of words it has not seen
    assert all(0.5 < t < 1 for t in total.values())


def test_exchange_finds_alternating_classes():
    """Words of two kinds that take turns: the two kinds are the classes."""
    rng = np.random.default_rng(0)
    counts = np.zeros((11, 11))
    prev = 0
    for i in range(4000):
        w = int(rng.integers(0, 5)) * 2 + i % 2
        counts[prev, w] += 1
        prev = w
    cls = classlm.exchange(counts, 10, 2)
    assert len(set(cls[:10:2])) == 1 and len(set(cls[1:10:2])) == 1 and cls[0] != cls[1] and cls[10] == 2


def test_words_outside_the_first_are_classed_by_their_neighbours(spark):
    """Nouns and verbs of one look: only the words next to them tell them apart."""
    rnd = np.random.default_rng(5)
    nouns, verbs = ([f"{c}{chr(97 + i)}{chr(97 + i % 7)}" for i in range(20)] for c in "nv")
    texts = [" ".join(f"the {rnd.choice(nouns)} is {rnd.choice(verbs)}" for _ in range(10)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = classlm.word_counts(docs).cache()
    assert len({r["look"] for r in vocabulary.collect()}) == 1
    known, _ = classlm.frequent(vocabulary, 100)
    model = classlm.class_model(docs, vocabulary, known, clustered=10, classes=4)
    cls = dict(zip(known["word"].to_pylist(), model["cls"].tolist()))
    a, b = ({cls[w.encode()] for w in x} for x in (nouns, verbs))
    assert len(known) == 42 and not a & b
    assert np.allclose((10 ** model["trans"]).sum(axis=1), 1)
    # the same where most words meet their class in the join
    some = classlm.frequent(vocabulary, 20)[0]
    assert 10 < len(some) < 42
    whole, joined = (classlm.scores(docs, F.lit(False), 10, 4, k).toPandas().sort_values("doc_id") for k in (100, 20))
    assert joined["score"].to_numpy() == pytest.approx(whole["score"].to_numpy())
    assert joined["n_known"].tolist() == whole["n_known"].tolist()


def test_best_class_is_the_one_of_most_likelihood():
    rnd = np.random.default_rng(6)
    k, c = 30, 6
    counts = rnd.poisson(0.7, (k, k)).astype(float)
    cls = np.append(rnd.integers(0, c - 1, k - 1), c - 1)

    def tables(cls):
        m = np.eye(c)[cls]
        return m, m.T @ counts @ m

    def likelihood(cls):
        t = tables(cls)[1]
        f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
        return f(t) - f(t.sum(axis=1)) - f(t.sum(axis=0))

    m, t = tables(cls)
    alone = counts * (1 - np.eye(k))
    cells = np.concatenate([alone @ m, (m.T @ alone).T, np.diag(counts)[:, None]], axis=1)
    words = np.arange(k - 1)
    got = classlm.best_classes(cls[:-1], cells[:-1], t, c - 1)
    some = classlm.best_classes(cls[:-1], cells[:-1], t, 3)
    for w in words:
        moved = [likelihood(np.where(np.arange(k) == w, b, cls)) for b in range(c - 1)]
        assert moved[got[w]] == pytest.approx(max(moved), abs=1e-9)
        assert moved[some[w]] == pytest.approx(max(moved[:3]), abs=1e-9)


def test_class_lm_of_odd_rows(spark, odd_docs, no_docs):
    got = classlm.scores(odd_docs, classlm.crc_mod("doc_id", 10) == 0).collect()
    assert len(got) == odd_docs.count()
    assert all(r.held_out for r in got if r.doc_id is None)  # the empty text's hash
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 6)} == {1}
    assert classlm.scores(no_docs, classlm.crc_mod("doc_id", 10) == 0).count() == 0
    untrained = classlm.scores(odd_docs, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in untrained} == {(0, 0)}


def test_scores_equal_the_class_model_by_brute_force(spark, rows):
    """The score of every text from the returned classes, by plain loops over its words."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["a b a b c. the d", "b a d The a", "", "a Étude the d", "x y a new word.", "b b b"] * 4)], "doc_id long, text string")
    held = F.col("doc_id") % 6 == 4
    training = docs.where(~held)
    vocabulary = classlm.word_counts(training).cache()
    known, _ = classlm.frequent(vocabulary, 100)
    m = classlm.class_model(training, vocabulary, known, clustered=3, classes=2)
    cls = dict(zip(known["word"].to_pylist(), m["cls"].tolist()))
    n = dict(zip(known["word"].to_pylist(), m["n"].tolist()))
    got = {r.doc_id: r.score for r in classlm.scores(docs, held, clustered=3, classes=2, known_words=100).collect()}
    for doc_id, text in docs.collect():
        at, total = m["edge"], 0.0
        for w in [*classlm.tokens(text), None]:
            c = m["edge"] if w is None else cls[w] if w in cls else m["look0"] + classlm.look(w)
            total += m["trans"][at, c]
            if w is not None:  # the end is all there is of its class
                total += math.log10(n.get(w, 0) + classlm.ALPHA) - m["divisor"][c]
            at = c
        assert got[doc_id] == pytest.approx(total), text
