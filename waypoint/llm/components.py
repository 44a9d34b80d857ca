"""Connected components of a link table, as repeated joins and minima.

Alternates the two star steps of the map-reduce literature: every node links
its larger neighbours to the least node it knows, then its smaller ones. Each
round is written under the shared checkpoint folder (an executor loss costs
one round) and a count and checksum of the links tell when nothing changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypoint.session import materialize


def _down(df: DataFrame) -> DataFrame:
    """Links as (u, v) with u > v, once each."""
    return (df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .where("u > v").distinct())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _down(both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.join(least, "u").select(F.explode(F.array(
        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("l"))
    return _down(linked.select("l.u", "l.v"))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); root is the least node reachable.

    Self links and repeated links change nothing; an empty table gives an
    empty table. Nodes without a link are not listed.
    """
    e = materialize(_down(links), "links")
    mark = _mark(e)
    while mark[0]:
        e = materialize(_small_star(_large_star(e)), "links")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
