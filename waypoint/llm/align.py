"""Cross-tokenizer alignment by an associative monoid of fragments.

A text is tokenised by a byte-level BPE file (A) and a byte-fallback piece
model (B). Byte offsets where tokens of both end cut the tokens into groups.

A byte range of a text, whatever its ends, gives a fragment: the tokens up to
its first common end (open prefix, which may begin in an earlier range), the
closed groups after it, and the tokens after its last common end (open suffix,
which a later range closes). Fragments of neighbouring ranges compose, and
composing is associative (``composed``), so the fragments of a very long
document are made in many tasks and reduced as a tree, ``FAN`` neighbours at a
time, each level a grouping by (document, place). Only the finished string of
groups of one document, which its digest needs, is ever in one place.

Long documents are cut before a blank that follows a character which is
neither white space nor the blank stand-in of B: neither tokenizer has a token
across such a place (A's split pattern ends there; no piece of B holds a blank
after another character, which is checked when B is loaded), so ranges are
tokenised apart with the same tokens. A stretch without such a place stays in
one range.

Links (the tokens of A and B that end together) are stored once as sorted id
pairs of 4 bytes with their numbers. Their counts over the corpus come from
sums inside the tasks first; the most frequent ``FREQUENT`` pairs reach all
tasks as sorted arrays, pairs beyond are counted by a join.

Defined cases: a null or empty text, or one whose joined tokens differ from
blank + text (a text with B's blank stand-in), has no tokens: zeros and an
empty digest; rows that repeat an id are separate documents; a null id stays
null; strings of special tokens are plain text; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.llm.common import table, text_or_empty
from waypoint.llm.packing import FileTokenizer
from waypoint.session import materialize

#: Code points from which a document is cut into ranges of about as many.
RANGE = 1 << 16
#: Fragments composed by one step of the tree.
FAN = 16
#: Pairs whose counts reach all tasks (13 bytes each).
FREQUENT = 1 << 20
#: B's stand-in for a blank, and its form of single bytes.
STAND_IN = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: A blank with a character before it that neither tokenizer joins to it.
CUT = re.compile(rf"(?<=[^\s{STAND_IN}]) ")

NONE = np.zeros(0, np.uint32)
DOC = "key long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"
FRAGMENT = ("key long, doc_id long, place long, ok boolean, closed boolean, n_a long, n_b long, n_groups long, "
            "pa binary, pb binary, body binary, sa binary, sb binary")


class Tokens:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        self.a = FileTokenizer(path_a)
        by_id = {i: b for b, i in self.a.ranks.items()}
        self.bytes_a = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(STAND_IN in p.lstrip(STAND_IN) for p in pieces):
            raise ValueError("a piece holds a blank after another character: ranges would not tokenise alike")
        byte = [BYTE_PIECE.fullmatch(p) if self.b.is_byte(i) else None for i, p in enumerate(pieces)]
        self.bytes_b = [bytes([int(m[1], 16)]) if m else p.replace(STAND_IN, " ").encode() for m, p in zip(byte, pieces)]
        self.len_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.len_b = np.array([len(b) for b in self.bytes_b], np.int64)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of blank + ``text`` by A and B; none if either does not give its bytes back."""
        want = b" " + text.encode()
        a, b = self.a.ids(" " + text, plain=True), self.b.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != want or (
                b"".join(map(self.bytes_b.__getitem__, b)) != want):
            return None
        return a, np.array(b, np.uint32)


#: Ids as digits with a sign after them, by sign and id: every id of A or B has five digits at most.
SIGNS = ",|;"


def _digits(size: int = 100_000) -> np.ndarray:
    return np.array([f"{i}{s}".encode() for s in SIGNS for i in range(size)], "S6").reshape(len(SIGNS), size)


_DIGITS: list[np.ndarray] = []


def groups_text(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, n: int) -> bytes:
    """``a1,a2|b1;a3|b2,b3;`` of closed groups 0 .. n - 1 (a group number for each token, ascending)."""
    if not _DIGITS:
        _DIGITS.append(_digits())
    out = np.empty(len(a) + len(b), "S6")
    ends_a, ends_b = np.searchsorted(a_group, np.arange(n), "right"), np.searchsorted(b_group, np.arange(n), "right")
    sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    sign_a[ends_a - 1], sign_b[ends_b - 1] = 1, 2
    before_b = np.concatenate([[0], ends_b[:-1]]) if n else ends_b
    out[np.arange(len(a)) + before_b[a_group]] = _DIGITS[0][sign_a, a]
    out[np.arange(len(b)) + ends_a[b_group]] = _DIGITS[0][sign_b, b]
    return out.tobytes().replace(b"\0", b"")


@dataclass
class Fragment:
    """What a byte range knows of the groups; not ``closed`` if no common end lies in it (all is prefix then)."""

    ok: bool = True
    closed: bool = False
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    pa: np.ndarray = field(default_factory=lambda: NONE)  # prefix, with the tokens that end at the first common end
    pb: np.ndarray = field(default_factory=lambda: NONE)
    body: bytes = b""  # the closed groups after the first
    sa: np.ndarray = field(default_factory=lambda: NONE)
    sb: np.ndarray = field(default_factory=lambda: NONE)


def fragment(a: np.ndarray, end_a: np.ndarray, b: np.ndarray, end_b: np.ndarray) -> tuple[Fragment, np.ndarray]:
    """(fragment, linked id pairs as a * 2^15 + b) of a range's tokens and the byte offsets they end at."""
    at = np.searchsorted(end_b, end_a)
    hit = np.flatnonzero(end_b[np.minimum(at, len(end_b) - 1)] == end_a) if len(end_a) and len(end_b) else np.zeros(0, int)
    out = Fragment(closed=len(hit) > 0, n_a=len(a), n_b=len(b), n_groups=len(hit))
    if not out.closed:
        out.pa, out.pb = a, b
        return out, NONE
    last_a, last_b = hit + 1, at[hit] + 1  # tokens up to and with each common end
    out.pa, out.pb, out.sa, out.sb = a[:last_a[0]], b[:last_b[0]], a[last_a[-1]:], b[last_b[-1]:]
    mid_a, mid_b = a[last_a[0]:last_a[-1]], b[last_b[0]:last_b[-1]]
    each_a, each_b = np.diff(last_a), np.diff(last_b)
    n = len(hit) - 1
    out.body = groups_text(mid_a, np.repeat(np.arange(n), each_a), mid_b, np.repeat(np.arange(n), each_b), n)
    return out, (a[hit].astype(np.uint32) << 15) | b[at[hit]].astype(np.uint32)


def _one(a: np.ndarray, b: np.ndarray) -> bytes:
    return (",".join(map(str, a.tolist())) + "|" + ",".join(map(str, b.tolist())) + ";").encode()


def composed(parts: list[Fragment]) -> Fragment:
    """The fragment of neighbouring ranges from theirs, in order; associative, with ``Fragment()`` as its unit."""
    out = Fragment(ok=all(p.ok for p in parts), n_a=sum(p.n_a for p in parts), n_b=sum(p.n_b for p in parts),
                   n_groups=sum(p.n_groups for p in parts))
    body, open_a, open_b = [], [], []
    for p in parts:
        open_a.append(p.pa)
        open_b.append(p.pb)
        if p.closed:
            a, b = np.concatenate(open_a), np.concatenate(open_b)
            if out.closed:
                body.append(_one(a, b))
            else:
                out.closed, out.pa, out.pb = True, a, b
            body.append(p.body)
            open_a, open_b = [p.sa], [p.sb]
    a, b = np.concatenate(open_a or [NONE]), np.concatenate(open_b or [NONE])
    out.body = b"".join(body)
    if out.closed:
        out.sa, out.sb = a, b
    else:
        out.pa, out.pb = a, b
    return out


def finished(f: Fragment) -> tuple[int, int, int, str]:
    """(tokens of A, of B, groups, digest) of a whole text's fragment."""
    if not (f.ok and f.closed):
        return 0, 0, 0, ""
    h = hashlib.sha256(_one(f.pa, f.pb)[:None if f.body else -1])
    h.update(memoryview(f.body)[:-1])
    return f.n_a, f.n_b, f.n_groups, h.hexdigest()


def text_fragment(tokens: Tokens, text: str) -> tuple[Fragment, np.ndarray]:
    """Fragment and links of blank + ``text``."""
    both = tokens.of(text) if text else None
    if both is None:
        return Fragment(ok=False), NONE
    a, b = both
    return fragment(a, np.cumsum(tokens.len_a[a]), b, np.cumsum(tokens.len_b[b]))


def ranges(text: str, size: int) -> Iterator[str]:
    """Stretches of a text, each without the blank before it; see the module text."""
    at = 0
    while m := CUT.search(text, at + size):
        yield text[at:m.start()]
        at = m.end()
    yield text[at:]


def _links(codes: np.ndarray) -> tuple[bytes, bytes]:
    """The different pairs in order, and how often each occurs."""
    u, n = np.unique(codes, return_counts=True)
    return u.astype("<u4").tobytes(), n.astype("<u4").tobytes()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    cols = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(cols)],
                                      [c for c, _ in cols])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # few texts as Python objects at a time
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))


def _whole(path_a: str, path_b: str):
    """A row of DOC and the links of every (short) text; keys by place in the task."""
    schema = DOC + ", codes binary, numbers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rows, size = Tokens(path_a, path_b), [], 0
        key = TaskContext.get().partitionId() << 40
        for doc_id, text in _texts(batches):
            f, codes = text_fragment(tokens, text)
            rows.append((key, doc_id, *finished(f), *_links(codes)))
            key += 1
            size += len(text) + 100
            if size > 1 << 22:
                yield _batch(rows, schema)
                rows, size = [], 0
        yield _batch(rows, schema)

    return run, schema


def _cut(size: int):
    schema = "key long, doc_id long, place long, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = -1 - (TaskContext.get().partitionId() << 40)  # below zero: apart from the short ones
        for doc_id, text in _texts(batches):
            for place, part in enumerate(ranges(text, size)):
                yield _batch([(key, doc_id, place, part)], schema)
            key -= 1

    return run, schema


def _row(key: int, doc_id: int | None, place: int, f: Fragment) -> tuple:
    raw = lambda ids: ids.astype("<u4").tobytes()
    return (key, doc_id, place, f.ok, f.closed, f.n_a, f.n_b, f.n_groups, raw(f.pa), raw(f.pb), f.body, raw(f.sa), raw(f.sb))


def _fragment_of(r: dict) -> Fragment:
    ids = lambda x: np.frombuffer(x, "<u4")
    return Fragment(r["ok"], r["closed"], r["n_a"], r["n_b"], r["n_groups"], ids(r["pa"]), ids(r["pb"]), r["body"],
                    ids(r["sa"]), ids(r["sb"]))


def _fragments(path_a: str, path_b: str):
    """The fragment, and the links, of every range."""
    schema = FRAGMENT + ", codes binary, numbers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path_a, path_b)
        for key, doc_id, place, text in _texts(batches):
            f, codes = text_fragment(tokens, text)
            yield _batch([(*_row(key, doc_id, place, f), *_links(codes))], schema)

    return run, schema


def _compose(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["place"])
    f = composed([_fragment_of(r) for r in rows])
    first = rows[0]
    return pa.Table.from_batches([_batch([_row(first["key"], first["doc_id"], first["place"] // FAN, f)], FRAGMENT)])


def reduced(fragments: DataFrame) -> DataFrame:
    """One fragment a document: a tree of groupings, FAN neighbours to a step."""
    most = fragments.agg(F.max("place")).first()[0] or 0
    while most:
        fragments = (fragments.groupBy("key", F.floor(F.col("place") / FAN).alias("step"))
                     .applyInArrow(lambda t: _compose(t), FRAGMENT))
        most //= FAN
    return fragments


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            yield _batch([(r["key"], r["doc_id"], *finished(_fragment_of(r)))], DOC)


def aligned(docs: DataFrame, path_a: str, path_b: str, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(documents as DOC, links (key, codes, numbers)) of ``docs`` (doc_id, text); long ones have several link rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    long = F.length("text") > size
    short = materialize(rows.where(~long).mapInArrow(*_whole(path_a, path_b)), "aligned")
    cut = rows.where(long).mapInArrow(*_cut(size)).repartition("key", "place")
    parts = materialize(cut.mapInArrow(*_fragments(path_a, path_b)), "fragments")
    roots = materialize(reduced(parts.drop("codes", "numbers")), "roots")
    good = roots.where("ok and closed").select("key")
    links = (short.select("key", "codes", "numbers")
             .unionByName(parts.join(good, "key", "left_semi").select("key", "codes", "numbers")))
    return short.drop("codes", "numbers").unionByName(roots.mapInArrow(_finish, DOC)), links


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n) of a task's links, each pair once a flush."""
    codes, numbers, held = [], [], 0

    def flush():
        u, place = np.unique(np.concatenate(codes), return_inverse=True)
        return u, np.bincount(place, np.concatenate(numbers), len(u)).astype(np.int64)

    out = lambda u, n: pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(n)], ["code", "n"])
    for batch in batches:
        for c, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            codes.append(np.frombuffer(c, "<u4"))
            numbers.append(np.frombuffer(n, "<u4").astype(np.float64))
            held += len(codes[-1])
        if held > 1 << 22:
            u, n = flush()
            codes, numbers, held = [u], [n.astype(np.float64)], len(u)
            if held > 1 << 21:
                yield out(u, n)
                codes, numbers, held = [], [], 0
    if codes:
        yield out(*flush())


def pair_counts(links: DataFrame) -> DataFrame:
    """(code, n, top): links of each id pair in the corpus; whether no pair of its B id has more."""
    n = (links.select("codes", "numbers").mapInArrow(_summed, "code long, n long")
         .groupBy("code").agg(F.sum("n").alias("n")))
    n = materialize(n, "pair-counts").withColumn("b", F.col("code").bitwiseAND(F.lit((1 << 15) - 1)))
    most = n.groupBy("b").agg(F.max("n").alias("most"))  # a row an id of B
    return n.join(F.broadcast(most), "b").select("code", "n", (F.col("n") == F.col("most")).alias("top"))


def frequent_from(pairs: DataFrame, limit: int) -> int:
    """The least power of two that at most ``limit`` pairs reach in count."""
    sizes = {r["bits"]: r["k"] for r in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("bits"))
             .agg(F.count(F.lit(1)).alias("k")).collect()}  # a row a power of two
    bits, total = max(sizes, default=0) + 1, 0
    while bits and total + sizes.get(bits - 1, 0) <= limit:
        bits -= 1
        total += sizes.get(bits, 0)
    return 1 << bits


SCORED = "key long, n_links long, n_best long, count_sum long, rest array<long>, rest_numbers array<long>"


def _scored(codes: np.ndarray, counts: np.ndarray, top: np.ndarray):
    """Sums over each row's links of the pairs given (sorted by code); the others stay in ``rest``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c.split()[0]: [] for c in SCORED.split(", ")}
            for key, c, n in zip(*(x.to_pylist() for x in batch.columns)):
                c, n = np.frombuffer(c, "<u4").astype(np.int64), np.frombuffer(n, "<u4").astype(np.int64)
                at = np.searchsorted(codes, c)
                known = (codes[np.minimum(at, len(codes) - 1)] == c) if len(codes) else np.zeros(len(c), bool)
                at, m = at[known], n[known]
                for name, v in zip(out, (key, int(n.sum()), int((m * top[at]).sum()), int((m * counts[at]).sum()),
                                         c[~known].tolist(), n[~known].tolist())):
                    out[name].append(v)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return run


def align(docs: DataFrame, path_a: str, path_b: str, size: int = RANGE, frequent: int = FREQUENT) -> DataFrame:
    """A row a document: tokens, groups, links, and sums over the links of their pairs' counts in the corpus."""
    found, links = aligned(docs, path_a, path_b, size)
    pairs = materialize(pair_counts(links), "pairs")
    least = frequent_from(pairs, frequent)
    known = pairs.where(F.col("n") >= least).toArrow().sort_by("code")  # at most ``frequent`` rows
    arrays = [known.column(c).to_numpy() for c in ("code", "n", "top")]
    scored = links.select("key", "codes", "numbers").mapInArrow(_scored(*arrays), SCORED)
    rest = pairs.where(F.col("n") < least)
    sums = ["n_links", "n_best", "count_sum"]
    if not rest.isEmpty():
        scored = materialize(scored, "scored")
        far = (scored.where(F.size("rest") > 0).select("key", F.explode(F.arrays_zip("rest", "rest_numbers")).alias("x"))
               .select("key", F.col("x.rest").alias("code"), F.col("x.rest_numbers").alias("k"))
               .join(rest, "code")
               .select("key", F.lit(0).cast("long").alias("n_links"),
                       F.when(F.col("top"), F.col("k")).otherwise(0).alias("n_best"),
                       (F.col("k") * F.col("n")).alias("count_sum")))
        scored = scored.select("key", *sums).unionByName(far)
    total = scored.groupBy("key").agg(*[F.sum(c).alias(c) for c in sums])
    return found.join(total, "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in sums], "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte-level BPE (A) against pieces with byte fallback (B)."""
    import public_tokenizers
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model"))
