"""Mixing sources to target token weights with hash thresholds.

Every document has a fixed hash. A source's budget is met by its documents
below a hash threshold, so a larger budget always holds a smaller one's
documents. The threshold comes from histograms: tokens summed by source and
hash bucket show the one bucket in which the budget is crossed, and only that
bucket is split again, until it holds a single hash. No sort, and no pass
holds more than (sources x buckets) sums.

Budgets: sources in code-point order (null last) take the weights in turn and
share ``total_ratio`` of all tokens; no budget exceeds ``max_repeat`` times
its source, the excess going to the others by weight. A budget above its
source repeats every document the whole number of times and takes the rest
by threshold.

Defined cases: null texts have size 0; rows with the same id share a hash and
are taken together; a null id hashes as the empty text; sources without
tokens get target 0; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waypoint.llm.common import SPACE, id_text, table, text_or_empty, whole
from waypoint.operators.ordered import dense_ids
from waypoint.session import materialize

WEIGHTS = (5, 2, 1)
TOTAL_RATIO = 1.5
MAX_REPEAT = 2
#: Hash bits, and bits a histogram splits a bucket by.
KEY_BITS, STEP_BITS = 60, 12


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and \\t-\\r."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def doc_key(id_col: str = "doc_id") -> Column:
    """60 bits of a hash of the id."""
    return F.conv(F.substring(F.md5(id_text(id_col)), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total_ratio: float = TOTAL_RATIO,
            max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) for a table of (source, size)."""
    src = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ids = dense_ids(src.where("source is not null"), "source", out="rank")
    n = F.lit(len(weights))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.col("rank") - 1, n) + 1).cast("int"))
    named = ids.join(src, "source").select("source", "source_size", "rank")
    null = src.where("source is null").withColumn("rank", F.lit(ids.count() + 1).cast("long"))
    src = materialize(named.unionByName(null.select("source", "source_size", "rank"))
                      .withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_repeat)),
                      "ranked-sources")
    budget = src.agg(F.sum("source_size")).first()[0] or 0
    # water level: sources whose cap is below weight x level stand at their cap
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("w") * F.lit(level)
        capped, free = src.agg(F.sum(F.when(full, F.col("cap"))),
                               F.sum(F.when(~full, F.col("w")))).first()
        if not free:
            break
        new = (total_ratio * budget - (capped or 0.0)) / free
        if new <= level:
            break
        level = new
    return src.select("source", "source_size",
                      F.least("cap", F.col("w") * F.lit(level)).alias("target"))


def thresholds(keyed: DataFrame, target: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, below): documents are taken ``copies``
    times, and once more where their key is less than ``below``.

    ``keyed`` has (source, size, key). The whole document in which the budget
    is crossed is taken where that comes nearer to the target.
    """
    copies = F.when(F.col("source_size") > 0,
                    F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = (target.withColumn("copies", copies.cast("long"))
             .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
             .withColumn("prefix", F.lit(0).cast("long")).withColumn("acc", F.lit(0).cast("long"))
             .withColumn("below", F.when(F.col("rest") <= 0, F.lit(0)).cast("long")))
    state = materialize(state, "mix-state")
    done = None
    for bits in range(STEP_BITS, KEY_BITS + 1, STEP_BITS):
        open_ = state.where("below is null")
        closed = state.where("below is not null")
        done = closed if done is None else done.unionByName(closed)
        k = keyed.withColumnRenamed("source", "s")
        prefix = F.shiftright("key", KEY_BITS - bits + STEP_BITS) if bits > STEP_BITS else F.lit(0).cast("long")
        hist = (k.join(open_, k["s"].eqNullSafe(open_["source"]) & (prefix == F.col("prefix")))
                .groupBy("source", F.shiftright("key", KEY_BITS - bits).alias("bucket"))
                .agg(F.sum("size").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"),
                     F.first("rest").alias("rest"), F.first("acc").alias("acc")))
        order = Window.partitionBy("source").orderBy("bucket")  # at most 2^STEP_BITS rows a source
        cum = hist.withColumn("to", F.col("acc") + F.sum("n").over(order))
        edge = (cum.where("to >= rest").groupBy("source")
                .agg(F.min(F.struct("bucket", "n", "lo", "hi", "to", "rest")).alias("e"))
                .select(F.col("source").alias("s"), "e.*"))
        nearer = F.col("e_to") - F.col("rest") < F.col("rest") - (F.col("e_to") - F.col("n"))
        stepped = (open_.drop("acc", "prefix", "below")
                   .join(edge.select("s", "bucket", "n", "lo", "hi", F.col("to").alias("e_to")),
                         open_["source"].eqNullSafe(F.col("s")))
                   .select("source", "source_size", "target", "copies", "rest",
                           F.col("bucket").alias("prefix"), (F.col("e_to") - F.col("n")).alias("acc"),
                           F.when(F.col("lo") == F.col("hi"),
                                  F.when(nearer, F.col("lo") + 1).otherwise(F.col("lo"))).alias("below")))
        state = materialize(stepped, "mix-state")
        if state.where("below is null").isEmpty():
            break
    return materialize(done.unionByName(state).select(
        "source", "source_size", "target", "copies", "below"), "mix-thresholds")


def mixed(docs: DataFrame, weights=WEIGHTS, total_ratio: float = TOTAL_RATIO,
          max_repeat: int = MAX_REPEAT, id_col: str = "doc_id") -> DataFrame:
    """The threshold table of ``docs`` (see ``thresholds``) and the table of its rows'
    (id, source, size, key)."""
    keyed = materialize(docs.select(F.col(id_col).alias("doc_id"), "source",
                                    n_words(text_or_empty()).alias("size"),
                                    doc_key(id_col).alias("key")), "mix-keys")
    target = targets(keyed, weights, total_ratio, max_repeat)
    return thresholds(keyed.select("source", "size", "key"), target), keyed


def _times() -> Column:
    return F.col("copies") + F.when(F.col("key") < F.col("below"), 1).otherwise(0)


def take(docs: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """``docs`` as the mix takes them: rows left out, kept or repeated whole."""
    limits, _ = mixed(docs, id_col=id_col, **params)
    lim = limits.select(F.col("source").alias("__s"), "copies", "below")
    out = (docs.select(whole(docs), doc_key(id_col).alias("key"), F.col("source").alias("__source"))
           .join(lim, F.col("__source").eqNullSafe(F.col("__s"))))
    return (out.select("__row", F.explode(F.array_repeat(F.lit(0), _times().cast("int"))))
            .select("__row.*"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    limits, keyed = mixed(docs)
    k = keyed.withColumnRenamed("source", "s")
    return (k.join(limits, k["s"].eqNullSafe(limits["source"]))
            .select("doc_id", "size", "source_size", "target",
                    (F.col("size") * _times()).alias("taken")))


#: The same by one sort per source: cumulative sizes in key order against the budget.
OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w,
    source_size * 2.0::DOUBLE AS cap FROM s),
l(i, level) AS (
  SELECT 0, 0.0::DOUBLE UNION ALL
  SELECT i + 1, (SELECT (1.5::DOUBLE * sum(source_size)
      - coalesce(sum(CASE WHEN cap <= w.w * l.level THEN cap END), 0))
      / sum(CASE WHEN cap > w.w * l.level THEN w.w END) FROM w)
  FROM l WHERE i < 40),
t AS (SELECT source, source_size, least(cap, w * (SELECT max(level) FROM l)) AS target FROM w),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
r AS (SELECT *, target - copies * source_size AS rest FROM k),
g AS (SELECT source, key, sum(size) AS n FROM d GROUP BY ALL),
c AS (SELECT source, key, n, sum(n) OVER (PARTITION BY source ORDER BY key) AS upto FROM g),
e AS (SELECT c.source, c.key, r.rest > 0 AND (c.upto - c.n < r.rest)
    AND (c.upto < r.rest OR c.upto - r.rest < r.rest - (c.upto - c.n)) AS more
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source)
SELECT d.doc_id, d.size, r.source_size, r.target,
  (d.size * (r.copies + CASE WHEN e.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.key = e.key
"""
