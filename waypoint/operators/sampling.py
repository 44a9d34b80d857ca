"""Reproducible uniform sample of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypoint.functions.kernel import hash52


def sample_ids(ids: DataFrame, n: int, seed: int, strict: bool = True) -> DataFrame:
    """``n`` distinct ccids chosen uniformly (smallest seeded hash); a top-k, not a sort."""
    d = ids.select("ccid").distinct()
    out = d.orderBy(hash52(seed, F.col("ccid")), "ccid").limit(n)
    if strict and out.count() < n:
        raise ValueError(f"cannot take a sample of {n} customers: fewer exist")
    return out


def sample_customers(tx: DataFrame, n: int, seed: int) -> DataFrame:
    """All lines of a uniform sample of ``n`` customers (the testing mode of the model)."""
    ids = sample_ids(tx, n, seed)
    # the sample has exactly n rows: its broadcast is bounded by the parameter
    return tx.join(F.broadcast(ids), "ccid")
