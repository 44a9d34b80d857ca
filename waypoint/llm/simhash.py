"""SimHash near-duplicate classes through pigeonhole blocks.

A fingerprint has a bit for each majority over the hashes of a text's word
shingles. Two fingerprints within ``max_bits`` differ in at most that many of
``blocks`` bit blocks, so they agree in some choice of ``blocks - max_bits``
blocks: every such choice is a join key, which finds all close pairs.

Equal fingerprints are one node, so copies are never expanded. Groups of many
different fingerprints that are all close to one another are not expanded
either: neighbours in each key's sort order are linked and contracted first,
and the exact join then looks only at keys that still hold more than one
class, at pairs across classes, and with rows of the key's largest class on
one side only. Every link between different classes is verified by Hamming
distance; no bucket is capped or dropped.

Defined cases: null texts count as empty; texts without words have
fingerprint zero and link like any other; repeated rows give repeated result
rows; a null id never is a class id unless the class has no other; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waypoint.llm.common import is_empty, others, table, text_or_empty, whole
from waypoint.llm.components import components
from waypoint.session import materialize

SEED = 42
#: Hashes whose bits are counted at once (bounds memory on very long texts).
CHUNK = 1 << 16


def text_fingerprint(text: str, shingle: int) -> int:
    """Signed 64-bit SimHash of the lower-cased words' shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - k + 1
    a, b = starts[:n].tolist(), ends[k - 1:].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        h = b"".join([digest(joined[x:y], SEED) for x, y in zip(a[i:i + CHUNK], b[i:i + CHUNK])])
        bits = np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text",
                 kept: list[str] | None = None) -> DataFrame:
    """``docs`` without its text (columns ``kept``), with ``fp``: the whole text's signed 64-bit fingerprint."""
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(x, shingle) for x in s], dtype="int64")

    return docs.select(*(others(docs, text, "fp") if kept is None else kept),
                       F.pandas_udf(run, "long")(text_or_empty(text)).alias("fp"))


def _block_masks(blocks: int) -> list[int]:
    """``blocks`` masks of neighbouring bits that split 64 bits as evenly as possible."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keyed(nodes: DataFrame, blocks: int, max_bits: int) -> DataFrame:
    """A row for each node and choice of agreeing blocks: (k, key, sub).

    ``sub`` holds one more block, to spread a key's rows where a finer split is free."""
    masks = _block_masks(blocks)
    keys = []
    for k, kept in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = _signed(sum(masks[i] for i in kept))
        rest = [i for i in range(blocks) if i not in kept]
        sub = _signed(masks[rest[0]]) if rest else 0
        keys.append(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key"),
                             F.col("fp").bitwiseAND(F.lit(sub)).alias("sub")))
    return nodes.select("*", F.explode(F.array(*keys)).alias("b")).select(*nodes.columns, "b.*")


def _hamming(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def close_classes(nodes: DataFrame, max_bits: int = 4, blocks: int = 8) -> DataFrame:
    """(fp, root): the class of every distinct fingerprint in ``nodes`` (column fp).

    ``root`` is the least fingerprint of the class. Exact: classes are the
    components of the graph of all pairs within ``max_bits`` differing bits.
    """
    # 1. neighbours in each key's order: linear work, contracts dense groups
    w = Window.partitionBy("k", "key", "sub").orderBy("fp")
    near = (_keyed(nodes, blocks, max_bits).withColumn("prev", F.lag("fp").over(w))
            .where(F.col("prev").isNotNull() & (_hamming("fp", "prev") <= max_bits))
            .select(F.col("fp").alias("u"), F.col("prev").alias("v")))
    first = components(near)
    classed = materialize(
        nodes.join(first, nodes["fp"] == first["node"], "left")
        .select("fp", F.coalesce("root", "fp").alias("c")), "classed")

    # 2. keys that still hold several classes: all pairs across classes, verified
    whole = Window.partitionBy("k", "key")
    mixed = materialize(
        _keyed(classed, blocks, max_bits).drop("sub")
        .withColumn("lo", F.min("c").over(whole)).withColumn("hi", F.max("c").over(whole))
        .where("lo <> hi").drop("lo", "hi"), "mixed")
    if is_empty(mixed):
        return classed.select("fp", F.col("c").alias("root"))
    most = (mixed.groupBy("k", "key", "c").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("k", "key").agg(F.max(F.struct("n", "c"))["c"].alias("most")))
    light = (mixed.join(most, ["k", "key"]).where("c <> most")
             .select("k", "key", F.col("fp").alias("fa"), F.col("c").alias("ca")))
    links = (light.join(mixed, (light["k"] == mixed["k"]) & (light["key"] == mixed["key"])
                        & (F.col("ca") != F.col("c")) & (_hamming("fa", "fp") <= max_bits))
             .select(F.col("ca").alias("u"), F.col("c").alias("v")))
    second = components(links)
    return (classed.join(second, classed["c"] == second["node"], "left")
            .select("fp", F.coalesce("root", "c").alias("root")))


def near_duplicate_classes(docs: DataFrame, shingle: int = 4, max_bits: int = 4,
                           blocks: int = 8, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: its columns without the text, fp, and component_id (least id reachable)."""
    kept = others(docs, "text", "fp", "component_id", "root")
    return _classes(docs, kept, shingle, max_bits, blocks, id_col).select(*kept, "fp", "component_id")


def _classes(docs: DataFrame, kept: list[str], shingle: int, max_bits: int, blocks: int, id_col: str) -> DataFrame:
    prints = materialize(fingerprints(docs, shingle, kept=kept), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = materialize(close_classes(nodes.select("fp"), max_bits, blocks), "roots")
    named = nodes.join(roots, "fp")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(named.join(ids, "root").select("fp", "root", "component_id"), "named")
    return prints.join(of, "fp")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id") -> DataFrame:
    """The row of least id of each near-duplicate class, with all columns of ``docs``.

    Rows that share the least id are told apart by a hash of all their columns,
    so reruns agree; of exact copies of a row one stays. Texts cross the network
    once: the join and the choice among copies have the same keys.
    """
    cols = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and not c.startswith("__")]
    mark = F.xxhash64(*cols, *[c.isNull() for c in cols]).alias("__mark")
    of = F.col(id_col)
    rows = docs.select(of.alias("__of"), "text", mark)
    classes = _classes(rows, ["__of", "__mark"], shingle, max_bits, 8, "__of")
    key = ["__id", "__none", "__mark"]  # a null id as two columns without nulls
    named = lambda x: (F.coalesce(x, F.lit(0).cast("long")).alias("__id"), x.isNull().alias("__none"))
    first = (classes.groupBy("root")
             .agg(F.min(F.struct(F.col("__of").isNull(), F.col("__of"), F.col("__mark"))).alias("f"))
             .select(*named(F.col("f.__of")), F.col("f.__mark").alias("__mark")))
    kept = docs.select(whole(docs), *named(of), mark).join(first, key, "left_semi")
    one = Window.partitionBy(*key).orderBy(F.lit(0))
    return kept.withColumn("__n", F.row_number().over(one)).where("__n = 1").select("__row.*")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document (4-word shingles, 4 bits)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicate_classes(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
