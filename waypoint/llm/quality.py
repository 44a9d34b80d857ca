"""Quality classifier: regularised quadratic discriminant over document statistics.

Every document gives a short vector of transformed statistics of its whole
text. Counts, sums and products of the labelled rows' vectors, added up by
class in Spark (two rows of sums reach the driver, whatever the corpus), give
the class means and covariances; each covariance is shrunk towards the pooled
one and its diagonal. A score compares the two Gaussian log-densities through
Mahalanobis distances, with each class's Cholesky factor (inverted once)
carried to the tasks.

Defined cases: null texts count as empty and get a score like any other;
labels with null ids or null quality, or ids with contradicting labels, teach
nothing, and repeated labels teach once per document row; without labels of
both classes the score is the known class's smoothed share (0.5 without any);
extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.llm.common import crc_mod, others, table, text_or_empty
from waypoint.session import materialize

STATISTICS = ("word_length", "upper_letters", "symbols", "digits", "symbol_words",
              "unique_words", "top_word", "lines_per_word", "repeated_lines", "sentence_ends",
              "short_words", "odd_symbols")
DIGITS = bytes(range(0x30, 0x3A))
#: Words of plain prose that every text is mixed with, so that a few words are not extreme:
#: their number, and per word the other marks of prose (distinct words, most frequent word,
#: lines, sentence ends, words of up to three letters, letters).
PRIOR_WORDS, DISTINCT, TOP, LINES, ENDS, SHORT, LETTERS = 20, 0.8, 0.08, 0.02, 0.07, 0.35, 6
UPPERS, LOWERS = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
PLAIN = b".,;:!?'\"()-"
MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
ODD = bytes(b for b in MARKS if b not in PLAIN)


def statistics(text: str) -> list[float]:
    """Transformed statistics of a text: logarithms of sizes, square roots of shares."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    upper, lower = gone(UPPERS), gone(LOWERS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(words)
    m = PRIOR_WORDS
    w, size, cased = n + m, len(raw) + m * LETTERS, upper + lower + m * LETTERS
    ends = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    share = np.sqrt([
        upper / cased, gone(MARKS) / size, gone(DIGITS) / size,
        sum(c for x, c in seen.items() if not x.translate(None, MARKS)) / w,
        (len(seen) + m * DISTINCT) / w, (max(seen.values(), default=0) + m * TOP) / w,
        (len(lines) + m * LINES) / w, 1 - (len(set(lines)) + 1) / (len(lines) + 1), (ends + m * ENDS) / w,
        (sum(c for x, c in seen.items() if len(x) <= 3) + m * SHORT) / w, gone(ODD) / size])
    return [float(np.log(size / w)), *share.tolist()]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by ``stats`` (array of doubles)."""
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([statistics(x) for x in s])

    return docs.select(*others(docs, text, "stats", "score", "predicted"),
                       F.pandas_udf(run, "array<double>")(text_or_empty(text)).alias("stats"))


@dataclass
class Gaussians:
    """Log prior ratio, and a class's mean, inverse Cholesky factor and log determinant."""

    prior: float
    classes: list[tuple[np.ndarray, np.ndarray, float]] | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        if self.classes and len(x):
            parts = []
            for mean, inverse, logdet in self.classes:
                d = (x - mean) @ inverse.T
                parts.append(-0.5 * (d * d).sum(axis=1) - 0.5 * logdet)
            z = z + parts[1] - parts[0]
        # divided by the number of statistics: same order and same 0.5, without saturating
        return 1 / (1 + np.exp(-np.clip(z / len(STATISTICS), -30, 30)))


def class_sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per class of ``rows`` (label, stats): count, sum and sum of products."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    s = F.col("stats")
    got = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(s[i]) for i in range(d)],
        *[F.sum(s[i] * s[j]) for i, j in pairs]).collect()  # at most two rows
    out = {}
    for r in got:
        products = np.zeros((d, d))
        for (i, j), v in zip(pairs, r[2 + d:]):
            products[i, j] = products[j, i] = v
        out[int(r[0])] = (r[1], np.array(r[2:2 + d]), products)
    return out


def fit(rows: DataFrame, pooled: float = 0.1, diagonal: float = 0.1, floor: float = 1e-4) -> Gaussians:
    """The discriminant of ``rows`` (label 0 or 1, stats).

    A class covariance is ``1 - pooled`` of its own and ``pooled`` of the
    common one; then ``diagonal`` of the off-diagonal part goes, and ``floor``
    is added to each variance.
    """
    sums = class_sums(rows)
    n = [sums[c][0] if c in sums else 0 for c in (0, 1)]
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if not all(n):
        return Gaussians(prior * len(STATISTICS), None)
    means = [sums[c][1] / n[c] for c in (0, 1)]
    own = [sums[c][2] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    common = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    classes = []
    for mean, cov in zip(means, own):
        cov = (1 - pooled) * cov + pooled * common
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + floor * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        classes.append((mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    return Gaussians(prior, classes)


def _known(labels: DataFrame) -> DataFrame:
    """(__id, label): the documents whose labels agree."""
    return (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
            .groupBy(F.col("doc_id").alias("__id"))
            .agg(F.min("quality").alias("label"), F.max("quality").alias("__hi"))
            .where("label = __hi").select("__id", "label"))


def scored(docs: DataFrame, labels: DataFrame, teach=None, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without its text, with score (0 to 1) and predicted.

    ``teach`` is a condition on the id column that labelled rows must meet to
    be learned from (all, if none).
    """
    known = _known(labels)
    stats = materialize(with_statistics(docs), "statistics")
    rows = stats.where(teach) if teach is not None else stats
    model = fit(rows.select(F.col(id_col).alias("__of"), "stats")
                .join(known, F.col("__of") == F.col("__id")).select("label", "stats"))

    def run(s: pd.Series) -> pd.Series:
        x = np.array(s.tolist(), float).reshape(len(s), len(STATISTICS))
        return pd.Series(model.scores(x))

    return (stats.withColumn("score", F.pandas_udf(run, "double")("stats")).drop("stats")
            .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int")))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all columns.

    Two passes over the texts: the first adds up the class sums (statistics,
    not texts, meet the labels), the second scores and filters; texts are
    neither shuffled nor stored again.
    """
    known = _known(labels)
    stats = with_statistics(docs.select(F.col(id_col).alias("of"), "text"))
    model = fit(stats.join(known, F.col("of") == F.col("__id")).select("label", "stats"))

    def run(s: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in s], float).reshape(len(s), len(STATISTICS))
        return pd.Series(model.scores(x))

    return docs.where(F.pandas_udf(run, "double")(text_or_empty()) >= 0.5)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows with crc32(id) mod 3 = 1 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = crc_mod("doc_id", 3) == 1
    return (scored(docs, labels, teach=~held)
            .select("doc_id", held.alias("held_out"), "score", "predicted"))
