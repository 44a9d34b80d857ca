"""Language identification: all segmentations by brute force, expected uses, held-out accuracy, defined cases."""

import zlib
from collections import Counter
from itertools import combinations
from math import exp, log

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from waypoint.llm import langid as L
from waypoint.llm.common import crc_mod

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def segmentations(word: bytes, index: dict):
    for k in range(len(word)):
        for cuts in combinations(range(1, len(word)), k):
            parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)))]
            if all(p in index for p in parts):
                yield parts


@pytest.fixture(scope="module")
def small():
    pieces = [bytes([b]) for b in b" abcn"] + [b" a", b"ab", b"abc", b"ban", b"an", b"na", b" banana", b"abcabcna"]
    rnd = np.random.default_rng(1)
    p = rnd.random((len(pieces), 2))
    return pieces, np.concatenate([p / p.sum(axis=0), np.zeros((1, 2))])


WORDS = [b" banana", b" abc", b"n", b" a", b" abcabcna", b"bananban"]


def test_forward_sums_all_segmentations(small):
    pieces, prob = small
    index = {x: i for i, x in enumerate(pieces)}
    got = L.word_scores(WORDS, L.Index(pieces), prob)
    for w, row in zip(WORDS, got):
        for lang in (0, 1):
            want = sum(exp(sum(log(prob[index[p], lang]) for p in s)) for s in segmentations(w, index))
            assert row[lang] == pytest.approx(log(want))


def test_expected_uses(small):
    pieces, prob = small
    index = {x: i for i, x in enumerate(pieces)}
    lang, n = np.array([0, 1, 0, 1, 1, 0]), np.array([3, 1, 2, 5, 1, 7])
    want = np.zeros((len(index), 2))
    for w, x, k in zip(WORDS, lang, n):
        weight = {tuple(s): exp(sum(log(prob[index[p], x]) for p in s)) for s in segmentations(w, index)}
        for s, v in weight.items():
            for p in s:
                want[index[p], x] += k * v / sum(weight.values())
    got = L.expected(WORDS, lang, n, L.Index(pieces), prob) / L.UNIT
    assert np.abs(got - want).max() < 1e-3


def test_index_finds_every_piece_and_nothing_else():
    pieces = L.pieces_of(VOCABULARY)
    index, number = L.Index(pieces), {p: i for i, p in enumerate(pieces)}
    assert all(index.find(len(p), np.array([int.from_bytes(p, "big")], np.uint64))[0] == i
               for i, p in list(enumerate(pieces))[::97])
    word = " naïveté unübertroffen".encode()
    ids = L.spans([word, word[::-1]], len(word), index)
    for w, text in enumerate((word, word[::-1])):
        for end in range(1, len(text) + 1):
            for n in range(1, L.PIECE + 1):
                assert ids[end - 1, n - 1, w] == (number.get(text[end - n:end], len(pieces)) if n <= end else len(pieces))
    # far below the smallest double
    prob = np.full((len(pieces) + 1, 1), 1e-30)
    prob[-1] = 0
    assert L.word_scores([b"\xff" * 96], index, prob)[0, 0] == pytest.approx(96 * log(1e-30), rel=1e-3)


def test_words():
    assert L.words_of("Don't,") == [b" don", b" t"] and L.words_of("123_½") == []
    assert L.words_of("x" * 70) == [b" " + b"x" * 32, b"x" * 32, b"x" * 6]
    assert L.words_of("ÉÑ") == [" éñ".encode()]
    pieces = L.pieces_of(VOCABULARY)
    assert len(set(pieces)) == len(pieces) and {bytes([b]) for b in range(256)} <= set(pieces)


def test_query_equals_plain_loops_and_is_accurate(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in L.op12_language(spark, sf).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    held = [(r, got[r.doc_id]) for r in rows if got[r.doc_id].held_out and r.text]
    assert len(held) > 100 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert np.mean([g.lang_pred == r.lang for r, g in held]) > 0.97
    # the same model, applied word by word
    pieces = L.pieces_of(VOCABULARY)
    langs, prob, prior = L.learned(docs.where(crc_mod("doc_id", 5) != 0).select(
        "lang", F.coalesce("text", F.lit("")).alias("text")), pieces)
    index = L.Index(pieces)
    for r in rows[:25]:
        n = Counter(w for t in (r.text or "").split() for w in L.words_of(t))
        total = (L.word_scores(list(n), index, prob) * np.array(list(n.values()))[:, None]).sum(axis=0) + prior
        assert got[r.doc_id].lang_pred == langs[total.argmax()]
        assert got[r.doc_id].score == pytest.approx(1 / np.exp(total - total.max()).sum())


def test_odd_rows(spark, odd_docs, no_docs):
    got = L.identify(odd_docs, crc_mod("doc_id", 5) == 0, VOCABULARY)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 6))
    assert all(r.lang_pred in {"en", "fr", "de", "es"} and 0 < r.score <= 1 for r in rows if r.doc_id not in (2, 3, 6))
    assert L.identify(no_docs, crc_mod("doc_id", 5) == 0, VOCABULARY).count() == 0
    none = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(none, crc_mod("doc_id", 5) == 0, VOCABULARY).collect()} == {"und"}
    long = spark.createDataFrame([(1, "abcdé" * 100_000, "en"), (2, "東京" * 50_000, "ja"), (4, "der Hund", "de")],
                                 "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.identify(long, F.lit(False), VOCABULARY).collect()} == {"en", "ja", "de"}
