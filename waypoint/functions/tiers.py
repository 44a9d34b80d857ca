"""Loyalty-tier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["TIER_NAMES", "int_to_tier", "calculated_tier_code", "named_tier",
           "NAMED_TIER_LEVELS"]

# Recorded tier codes and names, and the lower-case names of
# the calculated tiers in level order.
TIER_NAMES = {1: "Blue", 2: "Silver", 3: "Gold", 5: "Platinum"}
NAMED_TIER_LEVELS = ("blue", "silver", "gold", "platinum")


def int_to_tier(x) -> Column:
    """Tier code -> name; any other code (or null) -> null."""
    x = F.col(x) if isinstance(x, str) else x
    out = None
    for code, name in TIER_NAMES.items():
        out = (F.when(x == code, F.lit(name)) if out is None
               else out.when(x == code, F.lit(name)))
    return out


def calculated_tier_code(units, thresholds=(5, 15, 30)) -> Column:
    """Band a unit count into tier codes 1, 2, 3, 5; null stays null."""
    u = F.col(units) if isinstance(units, str) else units
    a, b, c = thresholds
    return (F.when(u < a, F.lit(1)).when(u < b, F.lit(2))
             .when(u < c, F.lit(3)).when(u < F.lit(float("inf")), F.lit(5)))


def named_tier(start, prev, thresholds=(5, 15, 30)) -> Column:
    """Highest band reached by either measure; 'blue' otherwise."""
    s = F.col(start) if isinstance(start, str) else start
    p = F.col(prev) if isinstance(prev, str) else prev
    a, b, c = thresholds
    return (F.when((s >= c) | (p >= c), F.lit("platinum"))
             .when((s >= b) | (p >= b), F.lit("gold"))
             .when((s >= a) | (p >= a), F.lit("silver"))
             .otherwise(F.lit("blue")))
