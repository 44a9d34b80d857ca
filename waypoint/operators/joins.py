"""Lookup joins that stay balanced when one key holds a large share of the rows.

``hot_keys`` finds the keys holding more than ``share`` of a table's rows;
there are at most ``1 / share`` of them, so the list is small by
construction. ``lookup_join`` joins a fact table to a dimension with at most
one row per key: rows of hot keys carry a salt (a hash of the row, so a
retried task salts identically) and the dimension rows of hot keys are
replicated once per salt value, so the exchange spreads a hot key over
``salts`` partitions. Cold keys keep salt 0 and join as usual. One scan of
each side, one exchange, same rows as the plain join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SHARE = 0.001
#: Lines of a task at most, about: whole lines of so many rows are sorted in memory.
TASK_ROWS = 400_000
#: Rows of the other side from which a join is an exchange anyway, as they are too many for a broadcast.
EXCHANGED_ROWS = 300_000
#: Columns a hot row's salt is made of (those the fact side has): few, so that a
#: salted join leaves column pruning to its consumers.
SALT_COLUMNS = ("booking_code", "begin_use_date", "ccid")


def hot_of(counts: DataFrame, key: str, n: str, share: float = DEFAULT_SHARE) -> tuple:
    """Hot keys from a table that already counts rows by key (column ``n``)."""
    return hot_keys(counts, key, share, counts.select(key, F.col(n).alias("__n")))


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key (null included), combined map-side: one row per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))


def hot_keys(df: DataFrame, key: str, share: float = DEFAULT_SHARE,
             counts: DataFrame | None = None) -> tuple:
    """Values of ``key`` (null included) with more than ``share`` of the rows.

    ``counts`` may be a precomputed ``key_counts`` table (saves a pass).
    """
    counts = key_counts(df, key) if counts is None else counts
    total = counts.select(F.sum("__n")).scalar()
    bound = int(1 / share)
    rows = (counts.where(F.col("__n") > total * F.lit(share)).select(key)
            .limit(bound + 1).collect())
    if len(rows) > bound:  # impossible: more than 1/share keys cannot each exceed share
        raise AssertionError("hot key bound exceeded")
    return tuple(r[0] for r in rows)


def is_hot(col: Column, hot: tuple) -> Column:
    """Non-null boolean: the key is one of ``hot`` (a null key when None is listed)."""
    values = [v for v in hot if v is not None]
    cond = F.coalesce(col.isin(*values), F.lit(False)) if values else F.lit(False)
    if any(v is None for v in hot):
        cond = cond | col.isNull()
    return cond


def task_count(spark, rows: int, other: int) -> int | None:
    """Partitions for a join of ``rows`` lines to ``other`` rows, so that its sorts do not spill; None where the
    session's partitions do, or the other side may be broadcast."""
    n = -(-rows // TASK_ROWS)
    return n if other > EXCHANGED_ROWS and n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _salts(df: DataFrame, salts: int | None) -> int:
    if salts:
        return salts
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lookup_join(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner",
                hot: tuple = (), null_safe: bool = False, salts: int | None = None,
                spread_copies: bool = False) -> DataFrame:
    """``fact`` joined to ``dim`` (at most one row per key) on ``key``.

    ``how``: inner, left, left_semi or left_anti. ``null_safe``: a null key
    matches the dimension's null key. Keeps one ``key`` column.

    ``spread_copies``: also hash the row's position, so exact copies of a row
    (a part loaded twice, say) spread over the salts too. Only for a fact side
    read straight from files, whose row positions a retried task reproduces;
    the join result never depends on the salt, only the balance does. The
    position is non-deterministic to the optimizer, so filters written after
    such a join are not pushed below it: filter first.

    The salt reads ``SALT_COLUMNS`` and, with ``spread_copies``, the position
    alone, never the whole row; a fact side without those columns is salted
    by its other columns.
    """
    if how in ("left_semi", "left_anti"):
        dim = dim.select(key).distinct()
    if not hot:
        if null_safe:
            d = dim.withColumnRenamed(key, "__k")
            return fact.join(d, fact[key].eqNullSafe(d["__k"]), how).drop("__k")
        return fact.join(dim, key, how)
    s = _salts(fact, salts)
    narrow = [c for c in SALT_COLUMNS if c in fact.columns and c != key]
    spread = ([F.monotonically_increasing_id()] if spread_copies
              else [F.col(c) for c in narrow or [x for x in fact.columns if x != key]])
    f = fact.withColumn("__salt", F.when(
        is_hot(F.col(key), hot), F.pmod(F.xxhash64(*spread), F.lit(s))).otherwise(F.lit(0)))
    d = (dim.withColumnRenamed(key, "__k")
            .withColumn("__salt", F.explode(F.when(
                is_hot(F.col("__k"), hot), F.sequence(F.lit(0), F.lit(s - 1)))
                .otherwise(F.array(F.lit(0))))))
    k_eq = f[key].eqNullSafe(d["__k"]) if null_safe else (f[key] == d["__k"])
    out = f.join(d, k_eq & (f["__salt"] == d["__salt"]), how)
    drop = ["__salt"] if how in ("left_semi", "left_anti") else []
    out = out.drop(f["__salt"])
    if how not in ("left_semi", "left_anti"):
        out = out.drop(d["__salt"]).drop("__k")
    return out.drop(*drop) if drop else out
