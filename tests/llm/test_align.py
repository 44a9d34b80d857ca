"""Cross-tokenizer alignment: the monoid, cuts of long texts, and the query against plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.llm.conftest import SF
from waypoint.llm import align as A

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    return A.Tokens(PATH_A, PATH_B)


def plain_tokens(texts):
    """Ids and bytes of blank + text by the files' own libraries; None where bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer
    from waypoint.llm.packing import byte_level_ranks
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    by_id = {i: b for b, i in byte_level_ranks(PATH_A)[0].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    for t in texts:
        if not t:
            yield None
            continue
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        xa, xb = [(i, by_id[i]) for i in ia], [(i, piece(i)) for i in ib]
        whole = b" " + t.encode()
        yield (xa, xb) if b"".join(x for _, x in xa) == whole == b"".join(x for _, x in xb) else None


def brute(rows):
    """The query's rows for (doc_id, text), by loops over token ends."""
    docs, count = [], Counter()
    for (doc_id, _), both in zip(rows, plain_tokens([t for _, t in rows])):
        if both is None:
            docs.append((doc_id, None))
            continue
        ends = []
        for side in both:
            at, out = 0, {}
            for i, raw in side:
                at += len(raw)
                out[at] = i
            ends.append(out)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, lo = [], [], 0
        for e in common:
            groups.append("|".join(",".join(str(i) for p, i in side.items() if lo < p <= e) for side in (
                {p: ends[0][p] for p in range(lo + 1, e + 1) if p in ends[0]},
                {p: ends[1][p] for p in range(lo + 1, e + 1) if p in ends[1]})))
            links.append((ends[0][e], ends[1][e]))
            lo = e
        count.update(links)
        docs.append((doc_id, (len(both[0]), len(both[1]), len(groups), links, ";".join(groups))))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, d in docs:
        if d is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_g, links, text = d
        out.append((doc_id, n_a, n_b, n_g, len(links), sum(count[p] == most[p[1]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = ["", None, " ", "  two", "a▁b", "x<|endoftext|>y <s> </s> <0x41>", "東京 \U0001F600 é́ ñ",
       "tab\t\n\n  end  ", "a\0b\x1c c", "same text", "same text", " 　x", "a" + " " * 30_000 + "b", "q" * 20_000,
       "don't we'll naïve 12 345,6"]


def test_query_equals_loops(spark, rows):
    data = rows("documents", "doc_id, text")
    want = brute(data)
    got = A.op13_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("size, frequent", [(40, 10), (300, 1 << 20), (1 << 16, 0)])
def test_cut_texts_and_rare_pairs(spark, rows, size, frequent):
    """Short ranges, so that trees have several levels, and few pairs known to all tasks."""
    data = [(i, t) for i, t in rows("documents", "doc_id, text")[:25]]
    data += [(None if i == 3 else -i, t) for i, t in enumerate(ODD)]
    data += [(7, "word and ▁ " * 500), (8, " ".join(str(i % 97) for i in range(4000)))]
    df = spark.createDataFrame([(*r, 1, "z") for r in data], "doc_id long, text string, key int, place string").repartition(3)
    got = sorted((tuple(r) for r in A.align(df, PATH_A, PATH_B, size, frequent).collect()), key=repr)
    assert got == brute(data)


def test_fragments_compose_in_any_way(tokens):
    """Any byte ranges, composed in any tree, give the whole text's fragment."""
    rnd = random.Random(5)
    for text in ("hello wörld, naïve tokenisation of 東京 blocks 12345", "a", "  x\n\n y  z ", "Ünïcödé " * 9):
        a, b = tokens.of(text)
        end_a, end_b = np.cumsum(tokens.len_a[a]), np.cumsum(tokens.len_b[b])
        whole, links = A.fragment(a, end_a, b, end_b)
        for _ in range(40):
            cuts = sorted({0, int(end_a[-1]), *(rnd.randrange(int(end_a[-1]) + 1) for _ in range(rnd.randrange(9)))})
            parts = []
            for lo, hi in zip(cuts, cuts[1:]):  # a token lies in the range that holds its end
                ka, kb = (end_a > lo) & (end_a <= hi), (end_b > lo) & (end_b <= hi)
                parts.append(A.fragment(a[ka], end_a[ka], b[kb], end_b[kb]))
            assert np.concatenate([c for _, c in parts]).tolist() == links.tolist()
            tree = [f for f, _ in parts] + [A.Fragment()]
            while len(tree) > 1:
                i = rnd.randrange(len(tree) - 1)
                tree[i:i + 2] = [A.composed(tree[i:i + 2])]
            assert A._row(0, 0, 0, tree[0]) == A._row(0, 0, 0, whole)
            assert A.finished(tree[0]) == A.finished(whole)


def test_ranges_tokenise_alike(tokens):
    text = "One two  three\n four   five. " * 50 + "x" * 500 + " end"
    parts = list(A.ranges(text, 37))
    assert len(parts) > 10 and " ".join(parts) == text
    both = [tokens.of(p) for p in parts]
    for side in (0, 1):
        assert np.concatenate([x[side] for x in both]).tolist() == tokens.of(text)[side].tolist()


def test_empty_table(spark, no_docs):
    assert A.align(no_docs, PATH_A, PATH_B).count() == 0
