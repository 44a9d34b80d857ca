import random
import zlib

import numpy as np
import pytest

from waypoint.llm import mixing, packing


def water(sizes: list[int]) -> list[float]:
    """Targets by resharing the excess until none is above twice its source."""
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, capped = 1.5 * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(2 * sizes[i] for i in capped)
        share = {i: left * w[i] / sum(w[j] for j in free) for i in free}
        above = {i for i in free if share[i] > 2 * sizes[i]}
        if not above:
            return [2.0 * s if i in capped else share[i] for i, s in enumerate(sizes)]
        capped |= above


def test_targets(spark):
    sizes = [40, 1000, 7, 0, 350, 90, 5000]
    names = ["", "Z", "a", "b", "é", "東", None]
    rows = [(n, s) for n, s in zip(names, sizes)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    for n, t in zip(names, water(sizes)):
        assert got[n] == pytest.approx(t)


def test_mix_follows_targets_and_repeats(spark):
    rnd = random.Random(3)
    rows = [(i, "ab"[i % 7 == 0], " ".join(["w"] * rnd.randrange(1, 60))) for i in range(400)]
    rows.append((1000, None, " ".join(["x"] * 9)))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    limits, keyed = mixing.mixed(docs)
    by = {r.source: r for r in limits.collect()}
    got = {r.doc_id: r for r in mixing.take(docs).groupBy("doc_id").count().collect()}
    taken: dict = {}
    for r in keyed.collect():
        lim = by[r.source]
        times = lim.copies + (r.key < lim.below)
        assert times <= 2 and (got[r.doc_id]["count"] if r.doc_id in got else 0) == times
        taken[r.source] = taken.get(r.source, 0) + times * r.size
    for s, lim in by.items():
        assert abs(taken[s] - lim.target) <= 30 or s is None


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    got = mixing.take(odd_docs)
    assert got.columns == odd_docs.columns
    assert got.count() == mixing.take(odd_docs).count()  # reruns agree
    limits, keyed = mixing.mixed(odd_docs)
    assert keyed.count() == odd_docs.count()
    assert {r.doc_id: r.size for r in keyed.collect()}[6] == 0
    assert mixing.take(no_docs).count() == 0


def tokenised(texts: list[str]) -> list[np.ndarray]:
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.default_tokenizer())
    return [np.array([*e.ids, 0], "<u4") for e in tok.encode_batch(texts, add_special_tokens=False)]


def check(pieces: list, ids: dict) -> None:
    """Every id in one piece, in order; sequences gapless, within 1024, little padding."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == ids.keys()
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            part = ids[d][p.start:p.start + p.length]
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            assert zlib.crc32(part.tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids[d])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0  # a power of two: no padding


def test_query_packs_every_id_once(spark, rows):
    docs = rows("documents", "doc_id, coalesce(text, '')")
    ids = {d: t for (d, _), t in zip(docs, tokenised([t for _, t in docs]))}
    check(packing.op2_packing(spark, "/root/testdata/sf0.001").collect(), ids)


def test_step_groups_hold_like_windows(spark):
    got = packing.op2_packing(spark, "/root/testdata/sf0.001").toPandas()
    seqs = got.groupby("sequence_id").agg(window=("window", "first"), step=("step_group", "first"), n=("length", "sum"))
    groups = seqs.groupby("step")
    assert (groups["window"].nunique() == 1).all() and groups.size().max() <= packing.GROUP
    assert (seqs["n"] == seqs["window"]).all()


def test_tokenizer_equals_the_files_library():
    texts = ["", "  a  b ", "x<|endoftext|>y z", "a  b\n c \n d", "\t\t x", "é ñ  \r\n", "don't we'll", "１２ 34 ½",
             "\n a", "a\x1c b", "東京 \U0001F600", "a" + " " * 1_000_000 + "b", "a" + "\n" * 200_000, " \t" * 60_000 + "x y",
             "<|endoftext|>" + " " * 20_000 + "<|endoftext|>x" + " " * 20_000 + "y", "b" * 300_000]
    tok = packing.FileTokenizer(packing.default_tokenizer())
    for text, want in zip(texts, tokenised(texts)):
        assert [*tok.ids(text).tolist(), 0] == want.tolist()


def test_pack_odd_rows(spark, odd_docs, no_docs):
    got = packing.pack(odd_docs, packing.default_tokenizer()).collect()
    assert {p.doc_id for p in got} == {r.doc_id for r in odd_docs.collect()}
    assert [p.length for p in got if p.doc_id in (2, 3)] == [1, 1]
    assert sum(p.length for p in got if p.doc_id == 5) == 2 * len(tokenised(["One two THREE four five six"])[0])
    assert packing.pack(no_docs, packing.default_tokenizer()).count() == 0


@pytest.mark.parametrize("pool", [1, 7, 100])
def test_packer_rounds(pool):
    rnd = np.random.default_rng(2)
    docs = {i: rnd.integers(0, 50_000, n).astype("<u4") for i, n in enumerate(rnd.integers(1, 3000, 150))}
    packer = packing.Packer(3, pool=pool)
    for d, ids in docs.items():
        packer.add(d, ids)
    packer.pack(last=True)
    out = packer.take()
    check(list(out.itertuples()), docs)
    assert out["sequence_id"].min() >= 3 << 40


def test_step_groups_of_long_documents_are_full_and_balanced():
    """Whole windows of documents of one to three windows share groups with packed ones."""
    rnd = np.random.default_rng(4)
    packer = packing.Packer(0, pool=200)
    rows = []
    for d in range(600):
        packer.add(d, rnd.integers(0, 50_000, int(rnd.integers(1, 3500))).astype("<u4"))
        rows.append(packer.take())
    packer.pack(last=True)
    rows = packing.pd.concat([*rows, packer.take()])
    rows["cost"] = rows["length"] ** 2
    seqs = rows.groupby("sequence_id").agg(window=("window", "first"), step=("step_group", "first"), cost=("cost", "sum"))
    groups = seqs.groupby("step").agg(window=("window", "first"), n=("cost", "size"), cost=("cost", "sum"))
    assert groups["n"].max() == packing.GROUP
    assert (groups[groups["n"] < packing.GROUP].groupby("window").size() <= 1).all()
    full = groups[(groups["n"] == packing.GROUP) & (groups["window"] == 1024)]
    single = seqs[seqs["window"] == 1024]["cost"]
    assert len(full) > 50 and full["cost"].std() / full["cost"].mean() < 0.7 * single.std() / single.mean() / packing.GROUP ** 0.5


def test_whole_windows_wait_within_a_bound():
    packer = packing.Packer(0, dealt=16)
    for d in range(100):
        packer.add(d, np.zeros(2048, "<u4"))
        assert len(packer.ready[1024]) < 16
    packer.pack(last=True)
    assert packer.take().groupby("step_group").size().tolist() == [8] * 25
