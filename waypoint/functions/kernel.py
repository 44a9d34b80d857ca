"""Null semantics and small expression helpers.

The reference model follows R conventions that differ from SQL: sums and
minima propagate missing values, distinct counts count a missing value,
joins match missing keys to each other and ``round`` is half-to-even.
These helpers give those semantics with built-in expressions so that every
operator stays inside whole-stage code generation.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "MONEY",
    "strict_sum",
    "filled_sum",
    "strict_min",
    "n_distinct_na",
    "null_safe_join",
    "null_tokens",
    "text_year",
    "year_filter",
    "hash52",
    "round_half_even",
    "pmax_na",
    "spend_cut",
    "share_of_total",
]

#: Exact sums without rounding a cell finer than cents; held in a long like any decimal of 18 digits.
MONEY = "decimal(18,6)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict_sum(x) -> Column:
    """``sum`` that is null when any input is null (R ``sum`` without na.rm)."""
    x = _c(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def filled_sum(x, cond: Column | None = None) -> Column:
    """Conditional sum for a pivot cell with ``values_fill = 0``.

    0 when no row satisfies ``cond``; null when a satisfying row has a null
    value (the cell exists and its R sum is NA); the sum otherwise.
    """
    x = _c(x)
    if cond is None:
        cond = F.lit(True)
    hits = F.count(F.when(cond, F.lit(1)))
    vals = F.count(F.when(cond, x))
    total = F.sum(F.when(cond, x))
    return (F.when(hits == 0, F.lit(0))
             .when(vals == hits, total))


def strict_min(x) -> Column:
    """``min`` that is null when any input is null."""
    x = _c(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.min(x))


def n_distinct_na(x) -> Column:
    """Distinct count that counts a null as one more value (as R's ``n_distinct``)."""
    x = _c(x)
    return F.count_distinct(x) + F.max(x.isNull().cast("int"))


def null_safe_join(left: DataFrame, right: DataFrame, key: str,
                   how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` where null matches null; keeps one ``key`` column."""
    r = right.withColumnRenamed(key, "__nsk")
    out = left.join(r, left[key].eqNullSafe(r["__nsk"]), how)
    return out.drop("__nsk")


def null_tokens(x, tokens=("", "NA", "null")) -> Column:
    """Map textual null tokens to a real null."""
    x = _c(x)
    return F.when(~x.isin(*tokens), x)


def text_year(x) -> Column:
    """Year of an ISO date held as text; null when it does not parse."""
    return F.year(F.try_to_date(_c(x)))


def hash52(seed: int, x) -> Column:
    """Deterministic 52-bit integer from md5(seed ':' x) (same in DuckDB)."""
    s = F.concat(F.lit(f"{seed}:"), _c(x).cast("string"))
    return F.conv(F.md5(s).substr(1, 13), 16, 10).cast("long")


def year_filter(df: DataFrame, first: int, last: int | None = None,
                col: str = "begin_use_date") -> Column:
    """Use years ``first..last`` as a date range, plus the ``use_year``
    partition column when the table has one (so whole folders are pruned)."""
    last = first if last is None else last
    x = _c(col)
    pred = (x >= F.lit(_dt.date(first, 1, 1))) & (x < F.lit(_dt.date(last + 1, 1, 1)))
    if "use_year" in df.columns:
        pred = pred & F.col("use_year").between(first, last)
    return pred


def round_half_even(x) -> Column:
    return F.bround(_c(x), 0)


def pmax_na(a, b) -> Column:
    """R ``pmax``: null when either side is null."""
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def spend_cut(x, step: int, cap: int) -> Column:
    """``if_else(x > cap, cap, floor(x / step) * step)`` as a double."""
    x = _c(x).cast("double")
    return (F.when(x > F.lit(float(cap)), F.lit(float(cap)))
             .otherwise(F.floor(x / F.lit(float(step))) * F.lit(float(step)))
             .cast("double"))


def share_of_total(df: DataFrame, n: str = "n") -> Column:
    """``n / sum(n)`` over the whole table as a scalar subquery.

    The total is computed once by its own (partially aggregated) job and
    inlined, so there is neither a single-partition window nor a join.
    """
    total = df.select(F.sum(n).cast("double")).scalar()
    return F.col(n).cast("double") / total
