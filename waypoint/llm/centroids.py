"""Centroid clustering with equal-average equal-variance search, in exact integers.

Vectors are scaled and floored to integers. Centroids are sorted by the sum of
their components (their mean, times the length); a vector starts where its own
sum falls and scans outward, always to the side that is nearer in sum. Two
inequalities hold for every centroid c, with S the sum and V the root of
length x sum of squares - S^2 (the deviation, times the length):

    length x d2(x, c) >= (S_x - S_c)^2                      equal average
    length x d2(x, c) >= (S_x - S_c)^2 + (V_x - V_c)^2      and equal variance

The first ends a vector's scan, the second passes over one centroid. Both are
used in floating point with a margin that only ever keeps a centroid; what is
left gets its squared distance in integers, ties to the smaller number, so the
result equals a full search.

A round reads the vectors once. Its tasks add the members of each centroid up
and hand on a row a (centroid, component, limb): sums are cut into limbs of 62
bits, so integers of any size add up without loss. The driver sees one sum for
each centroid and component and nothing that grows with the vectors.

Defined cases: a vector takes part if it has ``dim`` components, none null or
non-finite; rows that repeat an id are separate vectors; a null id hashes as
the empty text when starts are chosen; starts of equal hash (repeated ids) go
in the order of their components; with fewer than ``k`` vectors each is a
start; distances, and their sums, beyond the largest long are given as the
largest long (choices between centroids stay exact); extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.llm.common import id_text, table
from waypoint.session import materialize

DIM, SCALE, K, ROUNDS = 64, 256, 40, 5
LIMB = 62
LONG = (1 << 63) - 1
#: Relative margin of the floating-point bounds.
MARGIN = 1e-9
#: Vectors searched together.
BATCH = 8192


def narrow(dim: int) -> int:
    """Components below this keep distances and moments exact in 64 bits; larger ones use Python's integers."""
    return (1 << 30) // max(dim, 4)


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: int64 where it fits the narrow path, else Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if not y.size or np.abs(y).max() < narrow(x.shape[-1]):
        return y.astype(np.int64)
    wide = lambda v: int(v) * scale if abs(v) >= 2.0 ** 53 else (  # noqa: E731  exact: a double is a ratio
        lambda n, d: n * scale // d)(*float(v).as_integer_ratio())
    return np.array([wide(v) for v in x.ravel()], object).reshape(x.shape)


def doubles(n: np.ndarray) -> np.ndarray:
    """Integers as doubles; beyond their range infinite."""
    if n.dtype != object:
        return n.astype(np.float64)
    return np.array([float(v) if abs(v) < 1 << 1023 else float("inf") if v > 0 else float("-inf") for v in n], np.float64)


class Search:
    """The nearest of a few integer centroids for batches of integer vectors."""

    def __init__(self, centroids: list[list[int]]):
        self.wide = any(abs(v) >= narrow(len(c)) for c in centroids for v in c)
        self.c = np.array(centroids, object if self.wide else np.int64)
        sums = [sum(c) for c in centroids]
        self.order = np.array(sorted(range(len(sums)), key=lambda i: (sums[i], i)))
        s, v = self.moments(self.c)
        self.s, self.v = s[self.order], v[self.order]

    @staticmethod
    def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum, length x deviation) of the rows: exact integers, then the nearest doubles."""
        s = x.sum(axis=1)
        over = x.shape[1] * (x * x).sum(axis=1) - s * s
        return doubles(s), np.sqrt(doubles(over))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance, distances taken) for the rows of ``x``."""
        c, dim, k = self.c, x.shape[1], len(self.order)
        if x.dtype == object or self.wide:
            x, c = x.astype(object), c.astype(object)
        s, v = self.moments(x)
        n, taken = len(x), 0
        best = np.zeros(n, np.int64)
        dist = np.zeros(n, x.dtype)
        found = np.zeros(n, bool)
        bound = np.full(n, np.inf)  # length x best squared distance, and the margin
        hi = np.searchsorted(self.s, s)
        lo = hi - 1
        live = np.arange(n)
        with np.errstate(invalid="ignore", over="ignore"):
            while len(live):
                left, right = lo[live], hi[live]
                dl = np.where(left >= 0, np.abs(s[live] - self.s[np.maximum(left, 0)]), np.inf)
                dr = np.where(right < k, np.abs(self.s[np.minimum(right, k - 1)] - s[live]), np.inf)
                go_left = (left >= 0) & ((right >= k) | (dl <= dr))
                place = np.where(go_left, left, right)
                gap = np.where(go_left, dl, dr)
                open_ = ((left >= 0) | (right < k)) & ~(gap * gap > bound[live])
                live, place, gap, go_left = live[open_], place[open_], gap[open_], go_left[open_]
                lo[live] -= go_left
                hi[live] += ~go_left
                dv = v[live] - self.v[place]
                test = ~(gap * gap + dv * dv > bound[live])
                rows, at = live[test], self.order[place[test]]
                taken += len(rows)
                diff = x[rows] - c[at]
                d = (diff * diff).sum(axis=1)
                better = ~found[rows] | (d < dist[rows]) | ((d == dist[rows]) & (at < best[rows]))
                better = better.astype(bool)
                rows, at, d = rows[better], at[better], d[better]
                found[rows] = True
                best[rows], dist[rows] = at, d
                # sums and deviations are off by 1e-16 of themselves at most
                bound[rows] = dim * doubles(d) * (1 + MARGIN) + MARGIN * (v[rows] ** 2 + s[rows] ** 2) + 1
        return best, dist, taken


def _rows(batch: pa.RecordBatch, dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, BATCH):
        part = batch.slice(at, BATCH)
        x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield part, scaled(x.reshape(-1, dim), scale)


def limbs(n: int) -> list[int]:
    """``n`` in signed limbs of LIMB bits, the lowest first."""
    sign, n, out = (-1 if n < 0 else 1), abs(n), []
    while n:
        out.append(sign * (n & ((1 << LIMB) - 1)))
        n >>= LIMB
    return out


def _sums(centroids: list[list[int]], dim: int, scale: int) -> Callable:
    """(centroid, pos, limb, s) of a task: its members' component sums, and their number at pos -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        total: dict[int, list[int]] = defaultdict(lambda: [0] * dim)
        count: dict[int, int] = defaultdict(int)
        for batch in batches:
            for _, x in _rows(batch, dim, scale):
                best = search.nearest(x)[0]
                for c in np.unique(best).tolist():
                    mine = x[best == c]
                    count[c] += len(mine)
                    total[c] = [a + int(b) for a, b in zip(total[c], mine.sum(axis=0))]
        out = [(c, -1, 0, n) for c, n in count.items()]
        out += [(c, p, i, v) for c, t in total.items() for p, n in enumerate(t) for i, v in enumerate(limbs(n))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            ["centroid", "pos", "limb", "s"])

    return run


def _assigned(centroids: list[list[int]], dim: int, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            for part, x in _rows(batch, dim, scale):
                best, dist, _ = search.nearest(x)
                if dist.dtype == object:
                    dist = np.array([min(d, LONG) for d in dist], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(best, pa.int32()), pa.array(dist, pa.int64())],
                    ["vec_id", "cluster", "distance"])

    return run


def kept(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
            .where((F.size("v") == dim) & ~odd))


def starts(rows: DataFrame, k: int = K, prefix: str = "2:", scale: int = SCALE) -> list[list[int]]:
    """The ``k`` vectors of smallest sha256 of the prefix and the id, as integers; at most k rows reach the driver."""
    h = F.sha2(F.concat(F.lit(prefix), id_text("vec_id")).cast("binary"), 256)
    first = rows.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [[int(v) for v in scaled(np.array([r["v"]], np.float64), scale)[0]] for r in first]


def moved(rows: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> list[list[int]]:
    """The centroids after one round: floors of their members' means; one without members stays."""
    task_sums = rows.mapInArrow(_sums(centroids, dim, scale), "centroid int, pos int, limb int, s long")
    total = defaultdict(int)
    for c, p, i, s in (task_sums.groupBy("centroid", "pos", "limb")
                       .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()):
        total[c, p] += int(s) << (LIMB * i)
    return [[total[c, p] // total[c, -1] for p in range(dim)] if total[c, -1] else old
            for c, old in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE,
            prefix: str = "2:") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance), final centroids) of ``vectors`` (vec_id, embedding)."""
    rows = kept(vectors, dim)
    centroids = starts(rows, k, prefix, scale)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    for _ in range(rounds):
        centroids = moved(rows, centroids, dim, scale)
    return rows.mapInArrow(_assigned(centroids, dim, scale), "vec_id long, cluster int, distance long"), centroids


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, squared distance and inertia of every kept embedding after five rounds from 40 hashed starts."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    found = materialize(found, "clusters")
    whole = lambda s: F.least(s, F.lit(LONG).cast("decimal(38,0)")).cast("long")
    each = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    info = spark.createDataFrame(
        [(c, str(each.get(c, 0)), str(sum(each.values())), d) for c, d in enumerate(digest)],
        "cluster int, own string, total string, centroid_sha256 string")
    info = info.select("cluster", whole(F.col("own").cast("decimal(38,0)")).alias("cluster_inertia"),
                       whole(F.col("total").cast("decimal(38,0)")).alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(info), "cluster").select(  # as many rows as centroids
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, prefix: str = "2:") -> str:
    """The query as SQL: a full search in every round."""
    def nearest(n: int) -> str:
        return (f"a{n} AS (SELECT r, vec_id, v, c, d FROM (SELECT e.r, e.vec_id, e.v, m.c, list_sum(list_transform("
                f"range(1, {dim + 1}), lambda i: (e.v[i] - m.v[i]) * (e.v[i] - m.v[i]))) AS d FROM e CROSS JOIN m{n} m) "
                "QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")

    def mean(n: int) -> str:
        floor = "(s - ((s % n) + n) % n) // n"
        return (f"m{n + 1} AS (SELECT m.c, coalesce(x.v, m.v) AS v FROM m{n} m LEFT JOIN (SELECT c, list({floor} ORDER BY p) AS v "
                f"FROM (SELECT c, p, sum(v[p])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, {dim + 1}) t(p) GROUP BY c, p) "
                "GROUP BY c) x USING (c))")

    steps = [f"{nearest(n)}, {mean(n)}" for n in range(rounds)]
    return (f"WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, "
            f"lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dim} "
            "AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))), "
            "m0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256("
            f"'{prefix}' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM e) ORDER BY h, v LIMIT {k}), "
            + ", ".join(steps) + f", {nearest(rounds)} "
            "SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance, "
            "(sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, "
            f"sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN m{rounds} m ON a.c = m.c")


OP11_SQL = _sql()
