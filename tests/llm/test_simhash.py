import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from waypoint.llm import simhash
from waypoint.llm.components import components


def plain(text: str) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(prints: list[int], bits: int = 4) -> list[int]:
    """Least position reachable, by comparing all pairs."""
    f = np.array(prints, np.uint64)
    of = list(range(len(f)))
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= bits):
            a, b = of[i], of[int(j)]
            if a != b:
                of = [min(a, b) if x in (a, b) else x for x in of]
    return of


def test_query_equals_brute_force(spark, rows):
    docs = sorted(rows("documents", "doc_id, text"))
    got = {r.doc_id: r for r in simhash.op8_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    prints = [plain(t) for _, t in docs]
    least = classes_of(prints)
    assert len(got) == len(docs)
    for (d, _), p, c in zip(docs, prints, least):
        assert got[d].fingerprint == f"{p:016x}" and got[d].component_id == docs[c][0]


def test_classes_of_dense_groups_and_chains(spark):
    rnd = random.Random(5)
    prints = {0}
    for _ in range(3):  # dense groups around a centre, and chains that drift by up to 4 bits
        centre = rnd.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rnd.sample(range(64), rnd.randrange(5)):
                x ^= 1 << b
            prints.add(x)
        for _ in range(25):
            for b in rnd.sample(range(64), 4):
                centre ^= 1 << b
            prints.add(centre)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = dict(simhash.close_classes(spark.createDataFrame(signed, "fp long")).collect())
    want = classes_of(prints)
    by_root, by_class = {}, {}
    for (s,), c in zip(signed, want):
        by_root.setdefault(got[s], set()).add(s)
        by_class.setdefault(c, set()).add(s)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_class.values()))


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicate_classes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    of = {r.doc_id: r.component_id for r in got}
    assert of[1] == of[5] == 1  # case does not matter
    assert of[2] == of[3] == of[6] == 2  # no words: fingerprint zero
    assert of[None] is None
    assert simhash.near_duplicate_classes(no_docs).count() == 0


def test_keep_one(spark, odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 4, -7, 9, 10, None], key=str)
    other = spark.createDataFrame([(None, "a b c d e"), (None, "f g h i j"), (None, "f g h i j")], "doc_id long, text string")
    assert simhash.keep_one(other).count() == 2
    assert simhash.keep_one(no_docs).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 40)] + [(3, 3), (7, 8)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in range(7, 40))
    assert 3 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_every_close_pair_shares_a_key(spark):
    rnd = random.Random(1)
    base = rnd.getrandbits(63)
    pairs = []
    for i in range(100):
        x = base
        for b in rnd.sample(range(63), 4):
            x ^= 1 << b
        pairs.append((x,))
    df = spark.createDataFrame([(base,), *pairs], "fp long")
    keyed = simhash._keyed(df, 8, 4)
    mine = keyed.where(F.col("fp") == base).select("k", F.col("key").alias("key0"))
    met = keyed.join(mine, "k").where("key = key0").select("fp").distinct().count()
    assert met == len({p for p, in pairs} | {base})


def test_keep_one_chooses_alike_under_any_partitioning(spark):
    """Rows of equal id and text but another source: the same one stays, however the rows lie."""
    rows = [(1, "a b c d e", "en", s, 9) for s in ("x", None, "y", "z")] + [(None, "a b c d e", "en", "q", 9)]
    rows += [(2, "p q r s t u", None, "x", 11)] * 3 + [(None, "null id alone here now", "en", "x", 1)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = [sorted(map(repr, simhash.keep_one(spark.createDataFrame(r, schema).repartition(n)).collect()))
           for r, n in ((rows, 1), (rows[::-1], 5))]
    assert got[0] == got[1] and len(got[0]) == 3
