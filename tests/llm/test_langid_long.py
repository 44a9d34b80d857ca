"""Pieces of more than eight bytes: found exactly, summed over all segmentations, learned."""

from math import exp, log

import numpy as np
import public_tokenizers
import pytest

from tests.llm.test_langid import segmentations
from waypoint.llm import langid as L

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_no_piece_of_the_vocabulary_is_left_out():
    pieces = L.pieces_of(VOCABULARY)
    long = pieces.longer
    assert long and min(map(len, long)) > L.PIECE and len(set(long)) == len(long)
    index = L.Index(pieces)
    number = {p: i for i, p in enumerate(pieces)} | {p: index.none + 1 + i for i, p in enumerate(long)}
    assert index.size + 1 == len(pieces) + len(long) + 1
    for p in long[::41]:
        word = b"x" + p + b"y"
        ids = L.spans([word, word[::-1]], len(word), index)
        for w, text in enumerate((word, word[::-1])):
            for end in range(1, len(text) + 1):
                for n in range(1, end + 1):
                    got = ids[end - 1, n - 1, w] if n <= ids.shape[1] else index.none
                    assert got == number.get(text[end - n:end], index.none)


@pytest.mark.parametrize("least", [1, 1e-40])
def test_longer_pieces_count_in_every_segmentation(least):
    pieces = L.Pieces([bytes([b]) for b in b" abcn"] + [b"an", b"ab", b" ban"], [b" bananaba", b"abcabcabca", b"nanabananab"])
    rnd = np.random.default_rng(3)
    p = rnd.random((L.numbered(pieces), 2)) * least
    prob = np.insert(p, len(pieces), 0, axis=0)
    index = {x: i for i, x in enumerate(pieces)} | {x: len(pieces) + 1 + i for i, x in enumerate(pieces.longer)}
    words = [b" bananabanan", b"abcabcabcab", b"nanabananaba", b" banana", b" bananabanan"[::-1]]
    got = L.word_scores(words, L.Index(pieces), prob)
    lang, n = np.array([0, 1, 1, 0, 0]), np.array([3, 2, 4, 1, 5])
    uses = np.zeros((len(prob), 2))
    for w, row, x, k in zip(words, got, lang, n):
        each = {tuple(s): [sum(log(prob[index[q], i]) for q in s) for i in (0, 1)] for s in segmentations(w, index)}
        assert list(row) == pytest.approx([np.logaddexp.reduce([v[i] for v in each.values()]) for i in (0, 1)])
        for s, v in each.items():
            for q in s:
                uses[index[q], x] += k * exp(v[x] - row[x])
    found = L.expected(words, lang, n, L.Index(pieces), prob) / L.UNIT
    assert np.abs(found - np.delete(uses, len(pieces), axis=0)).max() < 1e-3


def test_longer_pieces_are_learned(spark):
    pieces = L.Pieces([bytes([b]) for b in range(256)], [b" bananabread"])
    texts = spark.createDataFrame([("xx", "bananabread " * 50), ("yy", "bread banana " * 50)], "lang string, text string")
    langs, prob, _ = L.learned(texts, pieces)
    assert langs == ["xx", "yy"] and prob.shape == (258, 2) and (prob[256] == 0).all()
    assert prob[257, 0] > 0.5 > prob[257, 1]
