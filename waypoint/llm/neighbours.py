"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by a pseudo-rotation (three rounds of random signs and a
fast Hadamard transform) and hashed to the signed axis it is nearest to; every
table has a rotation of its own. A query looks into the ``probes`` axes it is
nearest to in each of the ``tables``, and the candidates found there are
ranked by exact cosine. A query that finds fewer than ``k`` is searched again
against all rows, in blocks. Axes are taken once and stored with the packed
vectors; few tables with many probes keep what is shuffled small: a vector
goes once to each table.

Buckets are searched in blocks of at most about ``BLOCK`` candidates and as
many queries (by salts from the bucket's counts), so a bucket with a third of
all rows is many small tasks. Identical vectors are one node with the
``k + 1`` smallest ids, as no others can be among the nearest, and identical
queries are searched once.

Defined cases: vectors that are null, zero, or hold null or non-finite
numbers take no part, nor do null ids; rows that repeat an id and its vector
count once; an id with several vectors is as many rows, each a candidate of
the others, and as many queries, each with ranks of its own; vectors of
different lengths are not compared; ties go to the smaller id; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from waypoint.llm.common import is_empty, table
from waypoint.session import materialize

TABLES, PROBES = 4, 32
#: Candidates, and queries, that one block holds about.
BLOCK = 4096
SEED = 20
SALTS = 64
KEY = ["dim", "tab", "bucket"]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (their length a power of two), without scaling."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d)


def rotated(x: np.ndarray, which: int) -> np.ndarray:
    """Pseudo-rotation ``which`` of the rows, padded with zeros to a power of two."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, :x.shape[1]] = x
    rng = np.random.default_rng([SEED, which, size])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], size))
    return y


def probes_of(y: np.ndarray, probes: int) -> np.ndarray:
    """The signed axes (axis, or axis + length where negative) nearest to the rows, nearest first."""
    signed = np.concatenate([y, -y], axis=1)
    return np.argsort(-signed, axis=1, kind="stable")[:, :min(probes, signed.shape[1])]


def _coded(nodes: DataFrame, tables: int, probes: int) -> DataFrame:
    """(row, least, dim, vec, codes) of ``nodes`` (row, least, v): the packed vector and its ``probes`` nearest
    axes in each table."""
    kind = _kind(nodes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby(b["v"].map(len)):
                x = np.stack(part["v"].to_list()).astype(np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                codes = np.stack([probes_of(rotated(x, t), probes) for t in range(tables)], axis=1)
                yield pd.DataFrame({
                    "row": part["row"].to_numpy(), "least": part["least"].to_numpy(), "dim": dim,
                    "vec": [np.asarray(v, kind).tobytes() for v in part["v"]], "codes": codes.tolist()})

    return nodes.mapInPandas(run, "row long, least long, dim int, vec binary, codes array<array<int>>")


def _kind(nodes: DataFrame) -> type:
    """The number type that holds the components of ``v`` exactly."""
    return np.float32 if isinstance(nodes.schema["v"].dataType.elementType, FloatType) else np.float64


def _placed(coded: DataFrame, *columns: str) -> DataFrame:
    """A row for each axis of each table: dim, tab, bucket and ``columns``."""
    return (coded.select("dim", *columns, F.posexplode("codes").alias("tab", "axes"))
            .select("dim", "tab", F.explode("axes").alias("bucket"), *columns))


def _unpacked(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def _search(k: int, kind: type):
    """The ``k`` best candidates of each query of a block by cosine, ties to the smaller least id."""
    def run(cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": np.array([], np.int64), "row": np.array([], np.int64),
                              "least": np.array([], np.int64), "score": np.array([], np.float64)})
        if not len(cands) or not len(queries):
            return empty
        c, q = _unpacked(cands["vec"], kind), _unpacked(queries["vec"], kind)
        rows, least, asked = cands["row"].to_numpy(), cands["least"].to_numpy(), queries["row"].to_numpy()
        unit = lambda x: x / np.abs(x).max(axis=1, keepdims=True)  # noqa: E731  no overflow in the norms
        c, q = unit(c), unit(q)
        nc, nq = np.sqrt((c * c).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        out = []
        for lo in range(0, len(q), 256):
            near = (q[lo:lo + 256] / nq[lo:lo + 256, None]) @ (c / nc[:, None]).T
            edge = -np.partition(-near, k - 1, axis=1)[:, k - 1] if len(rows) > k else np.full(len(near), -2.0)
            for i, row in enumerate(near):
                pick = np.flatnonzero(row >= edge[i] - 1e-9)
                # summed pair by pair: equal vectors get equal scores in every block
                score = (c[pick] * q[lo + i]).sum(axis=1) / (nc[pick] * nq[lo + i])
                best = np.lexsort((least[pick], -score))[:k]
                out.append(pd.DataFrame({"query": asked[lo + i], "row": rows[pick][best], "least": least[pick][best],
                                         "score": score[best]}))
        return pd.concat(out, ignore_index=True) if out else empty

    return run


def _blocks(cands: DataFrame, queries: DataFrame, sizes: DataFrame, k: int, kind: type) -> DataFrame:
    """The search of every bucket, in blocks by the bucket's counts (nc, nq in ``sizes``)."""
    parts = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    # at most tables x 2 x length rows for a length of vectors
    sizes = sizes.select(*KEY, parts("nc").alias("pc"), parts("nq").alias("pq"))
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    by = [*KEY, "ci", "qi"]
    c = (cands.join(sizes, KEY).withColumn("ci", part("pc")).withColumn("qi", every("pq"))
         .select(*by, "row", "least", "vec"))
    q = queries.join(sizes, KEY).withColumn("qi", part("pq")).withColumn("ci", every("pc")).select(*by, "row", "vec")
    return c.groupBy(*by).cogroup(q.groupBy(*by)).applyInPandas(
        _search(k, kind), "query long, row long, least long, score double")


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the different rows, without the vectors that take no part."""
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(~odd).where(some).distinct()


def _nodes(rows: DataFrame, k: int) -> DataFrame:
    """(row, least, ids, v): each different vector with a number, its smallest id and its ``k`` smallest ids."""
    n = F.row_number()
    some = (rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
            .withColumn("n", n.over(Window.partitionBy("v", "salt").orderBy("vec_id"))).where(F.col("n") <= k)
            .withColumn("n", n.over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k))
    return (some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
            .select(F.monotonically_increasing_id().alias("row"), F.col("ids")[0].alias("least"), "ids", "v"))


def nearest(vectors: DataFrame, is_query, k: int = 5, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``vectors``
    (vec_id, embedding) that meets ``is_query`` (a condition on vec_id)."""
    rows = materialize(_valid(vectors.select("vec_id", F.col("embedding").alias("v"))), "vectors")
    # written, so that the numbers stay
    nodes = materialize(_nodes(rows, k + 1), "nodes")
    kind = _kind(nodes)
    own = materialize(rows.where(is_query).join(nodes.select("v", F.col("row").alias("key")), "v")
                      .select(F.col("vec_id").alias("query_id"), "key"), "asked")
    asked = nodes.join(own.select(F.col("key").alias("row")).distinct(), "row", "left_semi")
    cands = materialize(_coded(nodes.select("row", "least", "v"), tables, 1), "candidates")
    queries = materialize(_coded(asked.select("row", "least", "v"), tables, probes), "queries")

    count = lambda df, name: df.groupBy(*KEY).agg(F.count(F.lit(1)).alias(name))
    sizes = materialize(count(_placed(cands), "nc").join(count(_placed(queries), "nq"), KEY), "bucket-sizes")
    found = _blocks(_placed(cands, "row", "least", "vec"), _placed(queries, "row", "vec"), sizes, k + 1, kind)
    best = materialize(_ranked(found, own, nodes, k), "found")
    answer = ["query_id", "rank", "vec_id", "score"]

    # too few found: all rows of the query's length, in blocks
    few = (own.join(best.groupBy("query_id", "key").agg(F.count(F.lit(1)).alias("n")), ["query_id", "key"], "left")
           .where(F.coalesce("n", F.lit(0)) < k))
    few = materialize(few.select(F.col("key").alias("row")).distinct(), "few")
    if is_empty(few):
        return best.select(*answer)
    whole = lambda df: df.withColumns({"tab": F.lit(0), "bucket": F.lit(-1)})
    again = queries.join(few, "row", "left_semi")
    sizes = count(whole(cands), "nc").join(count(whole(again), "nq"), KEY)
    redone = own.join(few.withColumnRenamed("row", "key"), "key", "left_semi")
    second = _ranked(_blocks(whole(cands), whole(again), sizes, k + 1, kind), redone, nodes, k)
    return (best.join(few.withColumnRenamed("row", "key"), "key", "left_anti").select(*answer)
            .unionByName(second.select(*answer)))


def _ranked(found: DataFrame, own: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of what was found for each row of ``own``, without that row itself."""
    n = F.row_number()
    order = lambda by, last: Window.partitionBy(*by).orderBy(F.col("score").desc(), last)
    top = (found.groupBy("query", "row", "least").agg(F.max("score").alias("score"))
           .withColumn("n", n.over(order(["query"], "least"))).where(F.col("n") <= k + 1)
           .join(nodes.select("row", "ids"), "row")
           .select(F.col("query").alias("key"), "row", "score", F.explode("ids").alias("vec_id"))
           .withColumn("n", n.over(order(["key"], "vec_id"))).where(F.col("n") <= k + 1).drop("n"))
    return (own.join(top, "key").where("vec_id <> query_id OR row <> key")
            .withColumn("rank", n.over(order(["query_id", "key"], "vec_id"))).where(F.col("rank") <= k)
            .select("query_id", "key", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows by cosine of every embedding whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"),
                   F.col("vec_id") % 50 == 0)
