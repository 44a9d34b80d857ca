"""Transaction normalisation and stable customer ids."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from waypoint.operators.joins import hot_keys, is_hot, key_counts, lookup_join, task_count
from waypoint.operators.ordered import dense_ids
from waypoint.session import materialize
from waypoint.sources.cache import lines_by_year
from waypoint.sources.fixtures import NATURAL_KEY


def post_process_tx(df: DataFrame) -> DataFrame:
    """Rename the three raw columns (incl. the misspelt one); lower-case LOB."""
    return (df.withColumnsRenamed({"boooking_code": "booking_code",
                                   "line_of_business": "lob",
                                   "gross_booking_amount_usd": "gbv"})
              .withColumn("lob", F.lower("lob")))


def customer_ids(cust: DataFrame, tx: DataFrame, key: str = NATURAL_KEY) -> DataFrame:
    """Dense ``ccid`` over the union of natural keys of both tables (U1 + W8)."""
    keys = cust.select(key).unionByName(tx.select(key))
    return dense_ids(keys, key, "ccid")


def attach_ccid(df: DataFrame, ccids: DataFrame, key: str = NATURAL_KEY,
                hot: tuple = ()) -> DataFrame:
    """Replace the natural key by ``ccid``; null keys match the null key's id.

    ``hot`` natural keys (e.g. the missing e-mail) are salted over many tasks.
    """
    out = lookup_join(df, ccids, key, "inner", hot=hot, null_safe=True,
                      spread_copies=True).drop(key)
    return out.select("ccid", *[c for c in out.columns if c != "ccid"])


def attach_parts(lines: DataFrame, ccids: DataFrame, key: str = NATURAL_KEY, hot: tuple = (),
                 tasks: int | None = None) -> tuple[DataFrame, ...]:
    """``attach_ccid`` of lines in two parts: those of ordinary customers and, if any, those of ``hot`` keys.

    Hot lines meet their few ids (one row per listed key) by broadcast, without an exchange; the others are
    exchanged once, over ``tasks`` partitions where the session's are too few. Filters and column pruning of
    a consumer reach the scan of the lines.
    """
    cold = lines.where(~is_hot(F.col(key), hot)) if hot else lines
    null_safe = not any(v is None for v in hot)
    if tasks:
        # the exchange that the join asks for (missing keys match, so they are part of a null-safe join's keys)
        by = [F.coalesce(F.col(key), F.lit("")), F.col(key).isNull()] if null_safe else [F.col(key)]
        cold = cold.repartition(tasks, *by)
    ids = ccids.select(F.col(key).alias("__k"), "ccid")

    def joined(x: DataFrame, ids: DataFrame, null_safe: bool) -> DataFrame:
        on = x[key].eqNullSafe(ids["__k"]) if null_safe else x[key] == ids["__k"]
        out = x.join(ids, on).drop("__k", key)
        return out.select("ccid", *[c for c in out.columns if c != "ccid"])

    if not hot:
        return (joined(cold, ids, True),)
    return (joined(cold, ids.where(~is_hot(F.col("__k"), hot)), null_safe),
            joined(lines.where(is_hot(F.col(key), hot)), F.broadcast(ids.where(is_hot(F.col("__k"), hot))), True))


@dataclass(frozen=True)
class Dataset:
    """The model's tables after id processing."""
    cust: DataFrame
    tx: DataFrame
    ccids: DataFrame
    hot_ccids: tuple = ()  # customers holding a large share of the lines
    parts: tuple[DataFrame, ...] = ()  # ``tx`` in parts: ordinary customers (clustered, if stored), and the hot customers' lines
    n_lines: int = 0  # as counted by the id pass
    buckets: int | None = None  # of the clustered part
    by_year: tuple[tuple[int | None, int], ...] = ()  # lines of each use year, if they are too many to be exchanged at once

    @property
    def tx_parts(self) -> tuple[DataFrame, ...]:
        return self.parts or (self.tx,)


def process_ccids(cust: DataFrame, tx: DataFrame, key: str = NATURAL_KEY) -> Dataset:
    """Ids for both tables. The lines are read once for keys: one per-key count
    (written, key-sized) gives both the hot keys and the distinct keys."""
    counts = materialize(key_counts(tx, key), "line-key-counts")
    n_lines, n_keys = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count(F.lit(1))).first()
    hot_tx = hot_keys(tx, key, counts=counts)
    ccids = dense_ids(cust.select(key).unionByName(counts.select(key)), key, "ccid")
    hot_ids = tuple(r[0] for r in ccids.where(is_hot(F.col(key), hot_tx))
                    .select("ccid").limit(len(hot_tx) + 1).collect())
    parts = attach_parts(tx, ccids, key, hot_tx, task_count(tx.sparkSession, n_lines, n_keys))
    # the lines' hot keys serve the (much smaller) customer table too
    return Dataset(cust=attach_ccid(cust, ccids, key, hot_tx), tx=reduce(DataFrame.unionByName, parts),
                   ccids=ccids, hot_ccids=hot_ids, parts=parts, n_lines=n_lines,
                   by_year=lines_by_year(tx, n_lines))
