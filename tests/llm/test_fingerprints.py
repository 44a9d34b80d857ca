import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from waypoint.llm import fingerprints


def units(text: str) -> set:
    return set(re.findall(r"[^ \n]+(?: +[^ \n]+){0,%d}" % (fingerprints.RUN - 1), text))


def alike(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs: list) -> dict:
    """docs in descending id order: (n_chars, hash of the edited text, both likenesses)."""
    out = {}
    for i, (d, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), alike(units(t), units(edited)),
                  alike(units(t), units(nxt)))
    return out


def read_back(text: str, cells: int = 0) -> tuple[int, dict]:
    """(cells a sub-table, {cell: [count, digests, checks]}) of a published fingerprint, folded to ``cells``."""
    m, out = int(text[:8], 16), {}
    for i in range(8, len(text), 48):
        c, n, key, chk = (int(text[i + a:i + b], 16) for a, b in ((0, 8), (8, 16), (16, 32), (32, 48)))
        sub, spot = divmod(c, m)
        x = out.setdefault((sub, spot % (cells or m)), [0, 0, 0])
        out[(sub, spot % (cells or m))] = [x[0] + n, x[1] ^ key, x[2] ^ chk]
    return m, out


@pytest.fixture(scope="module")
def hashes(spark):
    """Of 64-bit digests: check hash and the three hashes that cells are taken from."""
    def of(keys: set) -> dict:
        signed = [(k - (1 << 64) if k >> 63 else k,) for k in keys]
        df = spark.createDataFrame(signed, "k long").select(
            "k", fingerprints._check(F.col("k")), *[F.xxhash64("k", F.lit(s)) for s in range(3)])
        full = (1 << 64) - 1
        return {r[0] & full: tuple(x & full for x in r[1:]) for r in df.collect()}
    return of


def peel(cells: dict, m: int, of: dict):
    """(digests on either side, whether it peeled empty) of a difference of sketches."""
    cells, out, again = {c: list(x) for c, x in cells.items()}, {}, True
    while again:
        again = False
        for (sub, spot), (n, key, chk) in list(cells.items()):
            if abs(n) != 1 or key not in of or of[key][0] != chk or of[key][1 + sub] % m != spot:
                continue
            if cells[(sub, spot)] != [n, key, chk]:
                continue
            out[key], again = n, True
            for s in range(3):
                x = cells.setdefault((s, of[key][1 + s] % m), [0, 0, 0])
                x[0], x[1], x[2] = x[0] - n, x[1] ^ key, x[2] ^ chk
    return out, not any(map(any, cells.values()))


def string_likeness(a: str, b: str, of: dict) -> tuple[float, bool]:
    """The likeness of two published fingerprints by their strings alone, and whether they peeled at once."""
    (ma, own_a), (mb, own_b) = read_back(a), read_back(b)
    alone_a, alone_b = peel(own_a, ma, of), peel(own_b, mb, of)
    assert alone_a[1] and alone_b[1]  # every published sketch peels by itself
    n = len(alone_a[0]), len(alone_b[0])
    m = min(ma, mb)
    fa, fb = read_back(a, m)[1], read_back(b, m)[1]
    diff = {c: [x - y if i == 0 else x ^ y for i, (x, y) in enumerate(
        zip(fa.get(c, [0, 0, 0]), fb.get(c, [0, 0, 0])))] for c in fa.keys() | fb.keys()}
    out, empty = peel(diff, m, of)
    d = len(out) if empty else len(alone_a[0].keys() ^ alone_b[0].keys())
    return (1.0 if not sum(n) else (sum(n) - d) / (sum(n) + d)), empty


def test_query_equals_brute_force(spark, rows, hashes):
    docs = sorted(rows("documents", "doc_id, coalesce(text, '')"), reverse=True)
    want, prints = expected(docs), {}
    got = fingerprints.op3_fingerprints(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_chars, r.edited_sha256) == want[r.doc_id][:2]
        assert (r.near_edited, r.near_next) == pytest.approx(want[r.doc_id][2:])
        prints.setdefault(dict(docs)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    # the likenesses are those of the strings
    got.sort(key=lambda r: -r.doc_id)
    halves = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for (_, t), (_, n) in zip(docs, [*docs[1:], docs[0]])]
    keys = spark.createDataFrame([(t,) for t in [t for _, t in docs] + halves], "text string").select(
        F.explode(fingerprints.digests(F.col("text"))).alias("k")).distinct().collect()
    of, at_once = hashes({r.k & ((1 << 64) - 1) for r in keys}), 0
    for r, after in zip(got, [*got[1:], got[0]]):
        near, first = string_likeness(r.fingerprint, r.edited_fingerprint, of)
        at_once += first
        assert near == pytest.approx(r.near_edited)
        assert string_likeness(r.fingerprint, after.fingerprint, of)[0] == pytest.approx(r.near_next)
    assert at_once > 0.5 * len(got)


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_document(spark, buckets):
    rnd = random.Random(buckets)
    ids = rnd.sample(range(-50, 10_000), 60)
    docs = [(i, f"text {i}") for i in ids]
    got = fingerprints.with_next(spark.createDataFrame(docs, "doc_id long, text string"), buckets).collect()
    order = sorted(ids, reverse=True)
    assert {r.doc_id: r.next_text for r in got} == {i: f"text {n}" for i, n in zip(order, [*order[1:], order[0]])}
    assert len({(r.bucket, r.place) for r in got}) == len(docs)


def test_next_of_odd_rows(spark, odd_docs, no_docs):
    got = fingerprints.with_next(odd_docs.select("doc_id", "text"), 4).collect()
    assert len(got) == odd_docs.count() and all(r.next_text is not None for r in got)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r.next_text)
    assert of[3] == [""] and of[2] == ["one two three four five six"] and of[-7] == ["no id here"]
    assert sorted(of[5]) == sorted(["One two THREE four five six", [r.text for r in got if r.doc_id == 4][0]])
    assert sorted(of[None]) == sorted(["no id here", "one"])  # the last one's next is the first
    assert fingerprints.with_next(no_docs.select("doc_id", "text"), 4).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string")
    assert sorted(r.next_text for r in fingerprints.with_next(nulls, 3).collect()) == ["a", "b"]
    one = spark.createDataFrame([(8, "a")], "doc_id long, text string")
    assert [r.next_text for r in fingerprints.with_next(one, 3).collect()] == ["a"]


def test_peeling_recovers_differences_with_few_cells(spark):
    """A first sketch far too small: failing pairs are tried again, larger, until all digests are out."""
    rnd = random.Random(7)
    pairs = []
    for i in range(40):
        common = [rnd.getrandbits(63) for _ in range(rnd.randrange(30))]
        a, b = ([rnd.getrandbits(63) for _ in range(rnd.randrange(0, 4 * i + 1))] for _ in range(2))
        pairs.append((i, common + a, b + common))
    df = spark.createDataFrame(pairs, "id long, a array<long>, b array<long>")
    got = {r.id: (set(r.only_a), set(r.only_b)) for r in fingerprints.differences(df, ["id"], first=2).collect()}
    for i, a, b in pairs:
        assert got.get(i, (set(), set())) == (set(a) - set(b), set(b) - set(a))


def test_fingerprint_is_the_sketch(spark, hashes):
    long = "\n".join(f"line {i}" for i in range(5_000))
    df = spark.createDataFrame([("a\nb",), ("b\na\na ",), ("",), ("c",), (long,)], "text string").select(
        "text", fingerprints.digests(F.col("text")).alias("k"))
    got = {r.text: r for r in df.select("*", fingerprints.fingerprint(F.col("k")).alias("f")).collect()}
    assert got["a\nb"].f == got["b\na\na "].f and len({r.f for r in got.values()}) == 4
    assert got[""].f == "%08x" % fingerprints.PUBLISHED and len(got["c"].f) == 8 + 3 * 48
    for r in got.values():
        m, cells = read_back(r.f)
        full = {k & ((1 << 64) - 1) for k in r.k}
        of = hashes(full)
        assert m >= len(full) and m & (m - 1) == 0
        want = {}
        for k in full:
            for s in range(3):
                x = want.setdefault((s, of[k][1 + s] % m), [0, 0, 0])
                x[0], x[1], x[2] = x[0] + 1, x[1] ^ k, x[2] ^ of[k][0]
        assert cells == want and peel(cells, m, of) == (dict.fromkeys(full, 1), True)


def test_sketches_that_do_not_peel_are_published_larger(spark, hashes):
    """Small sets whose first sketch has two digests in the same three cells."""
    sets = spark.range(600).select(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.xxhash64("id", i)).alias("k"))
    got = sets.select("k", fingerprints.fingerprint(F.col("k")).alias("f")).collect()
    of, sizes = hashes({k & ((1 << 64) - 1) for r in got for k in r.k}), set()
    for r in got:
        m, cells = read_back(r.f)
        out, empty = peel(cells, m, of)
        assert empty and out.keys() == {k & ((1 << 64) - 1) for k in r.k}
        sizes.add(m)
    assert min(sizes) == fingerprints.PUBLISHED and len(sizes) > 1


def test_long_blank_runs(spark):
    """Blank runs take linear time, in a line, at its ends and alone."""
    import time
    blank = " " * 1_500_000
    texts = [blank, f"a{blank}b", f"a{blank}\n{blank}b", f"{blank}x\ny{blank}"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(
        F.size(fingerprints.digests(F.col("text"))).alias("n"))
    start = time.time()
    assert [r.n for r in df.collect()] == [0, 1, 2, 2] and time.time() - start < 30
