"""Language-model scores from a class-based bigram model (Brown classes).

Every training word is put into a class by exchange. The most frequent words
go first, one at a time: each moves to the class that most raises the
likelihood of the class bigrams. All other training words move together out of
classes by look (last character, accents, length): the tasks count the classes
left and right of each, and send it to the class of best gain. Words not seen
in training belong to the class of their look; where transitions are counted,
a word seen once stands for them, as its text would find it unseen were it
left out. A text's score is the log10 probability of its words and end:
smoothed class transitions times smoothed word emissions.

Scale: two passes over the texts, none of which moves them: one counts words,
one stores every word's number, and all later passes work on arrays of
numbers. Word counts and counts of neighbour classes are combined in the tasks
before they are shuffled; the ``KNOWN`` most frequent words are broadcast.
Words outside ``KNOWN`` meet their class and count in a join, by a 64-bit hash
of the word and their place in the document; documents are then kept as one
class number a token. Classes grow as the fourth root of the vocabulary, so
the tables on the driver (their transitions, and those of the words that go
first, 16 a class) grow slower than the vocabulary's square root.

Defined cases: null texts count as empty and have the end alone as token;
repeated rows are scored once each; a null id is hashed as the empty text
(held out); without training rows counts are 0; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.llm.common import crc_mod, table, text_or_empty
from waypoint.session import materialize

#: Words exchanged first and their classes (both at least), sweeps; words whose counts every task knows.
CLUSTERED, CLASSES, MAX_SWEEPS, KNOWN = 2000, 32, 8, 400_000
#: Added to counts of words and of transitions.
ALPHA, KAPPA = 0.1, 20.0
#: Look of a word: last character (4) x first accented letter (9) x length (2).
LOOKS = 72
ASCII = bytes(range(128))
#: Entries a task gathers before it passes them on.
FLUSH = 500_000
#: Words exchanged first of each class, at least; words a task places at once.
LEADERS, PLACED = 16, 512


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space


def look(word: bytes) -> int:
    """Class of a word by its look, from 0 to LOOKS - 1."""
    last = word[-1]
    end = 0 if 0x61 <= last <= 0x7A or last >= 0x80 else 1 if last in b".!?" else 2 if last in b",;:" else 3
    high = word.translate(None, ASCII)
    accent = 1 + (high[1] >> 2 & 7) if len(high) > 1 else 0
    return (end * 9 + accent) * 2 + (len(word) > 6)


class Looks(dict):
    """Word to index; words it does not know have -1 - look (kept while there is room)."""

    def __missing__(self, word: bytes) -> int:
        n = -1 - look(word)
        if len(self) < KNOWN:
            self[word] = n
        return n


def hashes(words) -> np.ndarray:
    """Spark's xxhash64 of the words."""
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64).view(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, look, n) over all texts of ``docs`` (column text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def rows() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(seen), "look": [look(w) for w in seen], "n": list(seen.values())})
            seen.clear()
            return out

        for b in batches:
            for text in b["text"]:
                seen.update(tokens(text))
                if len(seen) > FLUSH:
                    yield rows()
        yield rows()

    parts = docs.select("text").mapInPandas(run, "word binary, look int, n long")
    return parts.groupBy("word", "look").agg(F.sum("n").alias("n"))


def frequent(vocabulary: DataFrame, limit: int) -> tuple[pa.Table, int]:
    """At most ``limit`` of the most frequent words (word, look, n; sorted), and the least count they have.

    All words of a count band come together: bands are taken from the top as
    far as the limit goes, so the choice needs no sort of the vocabulary.
    """
    band = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    sizes = vocabulary.groupBy(band.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()  # under 1100 rows
    total, least = 0, 1 << 30
    for b, k in sorted(((r["b"], r["k"]) for r in sizes), reverse=True):
        if total + k > limit:
            break
        total, least = total + k, b
    got = vocabulary.where(band >= least).select("word", "look", "n").toArrow()  # compact on the driver
    return got.sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks(), least


def numbered(docs: DataFrame, known: pa.Table, every: bool) -> DataFrame:
    """(rid, doc_id, ids, rare) of ``docs`` (doc_id, text), stored: the one pass that looks words up.

    ``ids``: 32 bits a token, the place of a known word, or -1 - look; ``rare``: the hashes of the
    latter in order, without them where ``every`` training word is known.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known["word"])
    names = ["rid", "doc_id", "ids", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Looks({w: i for i, w in enumerate(shared.value.to_pylist())})
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, ids, rare = b.slice(at, 512), [], []
                for text in part.column("text").to_pylist():
                    words = tokens(text)
                    x = np.fromiter(map(index.__getitem__, words), "<i4", len(words))
                    ids.append(x.tobytes())
                    rare.append(b"" if every else hashes([words[i] for i in np.flatnonzero(x < 0).tolist()]).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(rare, pa.binary())], names)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return materialize(rows.mapInArrow(run, "rid long, doc_id long, ids binary, rare binary"), "numbered")


#: Stands before, between and after the texts of a sequence of ids.
EDGE = -1000


def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids of some texts with EDGE around each, rare hashes) of rows (ids, rare), up to FLUSH tokens and one text more."""
    edge, ids, rare, held = np.array([EDGE], "<i4"), [], [], 0
    for b in batches:
        for x, h in zip(b.column("ids"), b.column("rare")):
            ids += [edge, np.frombuffer(x.as_buffer(), "<i4")]
            rare.append(np.frombuffer(h.as_buffer(), "<i8"))
            held += len(ids[-1]) + 1
            if held > 2 * FLUSH:
                yield np.concatenate([*ids, edge]).astype(np.int64), np.concatenate(rare)
                ids, rare, held = [], [], 0
    if ids:
        yield np.concatenate([*ids, edge]).astype(np.int64), np.concatenate(rare)


def transitions(coded: DataFrame, known: pa.Table, top: int) -> np.ndarray:
    """Counts of neighbouring tokens of ``coded``: the first ``top`` words, looks, and the text's edge (last)."""
    size = top + LOOKS + 1
    own = top + known["look"].to_numpy().astype(np.int64)
    own[:top] = np.arange(top)
    shared = coded.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = np.append(shared.value, 0), np.zeros(size * size, np.int64)
        for seq, _ in sequences(batches):
            x = np.where(seq == EDGE, size - 1, np.where(seq < 0, top - 1 - seq, own[np.maximum(seq, 0)]))
            total += np.bincount(x[:-1] * size + x[1:], minlength=size * size)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    cells = (coded.select("ids", "rare").mapInArrow(run, "cell long, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())  # at most size^2 rows
    out = np.zeros(size * size)
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(size, size)


def exchange(counts: np.ndarray, words: int, classes: int, sweeps: int = MAX_SWEEPS) -> np.ndarray:
    """Class of every row of ``counts``: the first ``words`` rows are exchanged between
    ``classes`` classes, the others keep a class of their own."""
    k = len(counts)
    cls = np.concatenate([np.arange(words) % classes, np.arange(k - words) + classes]).astype(np.int64)
    c = classes + k - words
    member = np.zeros((k, c))
    member[np.arange(k), cls] = 1
    to, fro = counts @ member, (member.T @ counts).T  # word to class, class to word
    t = member.T @ to
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    free = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            a, self_ = cls[w], counts[w, w]
            o, i = to[w].copy(), fro[w].copy()
            o[a] -= self_
            i[a] -= self_
            t[a] -= o
            t[:, a] -= i
            t[a, a] -= self_
            rows, cols = t[:classes], t[:, :classes].T
            gain = (xlogx(rows + o) - xlogx(rows)).sum(axis=1) + (xlogx(cols + i) - xlogx(cols)).sum(axis=1)
            d = t[free, free]
            gain += (xlogx(d + o[free] + i[free] + self_) - xlogx(d + o[free]) - xlogx(d + i[free]) + xlogx(d))
            n1, n2 = rows.sum(axis=1), cols.sum(axis=1)
            so, si = o.sum() + self_, i.sum() + self_
            gain -= xlogx(n1 + so) - xlogx(n1) + xlogx(n2 + si) - xlogx(n2)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            t[b] += o
            t[:, b] += i
            t[b, b] += self_
            if b != a:
                cls[w] = b
                moved += 1
                to[:, a] -= counts[:, w]
                to[:, b] += counts[:, w]
                fro[:, a] -= counts[w]
                fro[:, b] += counts[w]
        if moved <= words // 1000:
            break
    return cls


def neighbour_classes(coded: DataFrame, known: pa.Table, cls: np.ndarray, top: int, look0: int, c: int) -> DataFrame:
    """(h, own, cells, n): for each word but the first ``top`` of ``known``, how often each class stands
    right of it (cells from 0), left of it (from ``c``), and the word itself right of it (2c).

    ``cls``: classes of the known words. A word has a row for each of a task's flushes.
    """
    shared = coded.sparkSession.sparkContext.broadcast((cls, hashes(known["word"].to_pylist())))
    width = 2 * c + 1
    schema = pa.schema([("h", pa.int64()), ("own", pa.int32()), ("cells", pa.list_(pa.int32())),
                        ("n", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, known_h = shared.value
        for seq, rare in sequences(batches):
            fresh, at, number = np.unique(rare, return_index=True, return_inverse=True)
            unknown = (seq < 0) & (seq != EDGE)
            own = np.concatenate([first, look0 - 1 - seq[unknown][at], [c - 1]]).astype(np.int64)
            h = np.concatenate([known_h, fresh])
            seq[unknown] = len(first) + number
            seq[seq == EDGE] = -1  # the last of ``own``
            a, b = seq[:-1], seq[1:]
            same = (a == b) & (a >= 0)
            right, left = a >= top, (b >= top) & ~same
            key = np.concatenate([a[right] * width + np.where(same, 2 * c, own[b])[right],
                                  b[left] * width + c + own[a[left]]])
            key, n = np.unique(key, return_counts=True)
            word, cell = np.divmod(key, width)
            start = np.flatnonzero(np.diff(word, prepend=-1))
            at = pa.array(np.append(start, len(word)), pa.int32())
            w = word[start]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[w]), pa.array(own[w], pa.int32()), pa.ListArray.from_arrays(at, pa.array(cell, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(n, pa.int32()))], schema=schema)

    return coded.select("ids", "rare").mapInArrow(run, "h long, own int, cells array<int>, n array<int>")


def best_classes(own: np.ndarray, counts: np.ndarray, t: np.ndarray, free: int) -> np.ndarray:
    """Class of best exchange gain, of the first ``free``, of each word, all others left where they are.

    ``own``: the words' classes now; ``counts``: a row a word of its cells (see ``neighbour_classes``);
    ``t``: transitions of the classes.
    """
    c = len(t)
    out, into, self_ = counts[:, :c], counts[:, c:2 * c], counts[:, 2 * c]
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))

    def side(t: np.ndarray, out: np.ndarray, into: np.ndarray) -> np.ndarray:
        """Gain of the cells of each class's row of ``t``, the word's own counts taken out."""
        w, j = np.nonzero(out)
        n, a = out[w, j], own[w]
        rest, e = t[:free, j].T.copy(), np.arange(len(w))
        before = xlogx(t)[:free, j].T.copy()
        home = a < free
        rest[e[home], a[home]] -= n[home]
        back = np.flatnonzero(j == a)  # cells of the word's own class also lose what leads to the word
        rest[back] -= into[w[back], :free]
        both = back[home[back]]
        rest[both, a[both]] -= self_[w[both]]
        before[e[home], a[home]] = xlogx(rest[e[home], a[home]])
        before[back] = xlogx(rest[back])
        after = xlogx(rest + n[:, None]) - before
        return np.add.reduceat(after, np.flatnonzero(np.diff(w, prepend=-1)), axis=0)

    gain = side(t, out, into) + side(t.T, into, out)
    # a class's cell with itself has both sides at once
    w, b = np.nonzero((out[:, :free] > 0) & (into[:, :free] > 0) | (self_ > 0)[:, None])
    o, i, s = out[w, b], into[w, b], self_[w]
    d = t[b, b] - np.where(b == own[w], o + i + s, 0)
    np.add.at(gain, (w, b), xlogx(d + o + i + s) - xlogx(d + o) - xlogx(d + i) + xlogx(d))
    for n, total in ((out.sum(axis=1) + self_, t.sum(axis=1)), (into.sum(axis=1) + self_, t.sum(axis=0))):
        moved = xlogx(total[:free] + n[:, None]) - xlogx(total[:free])
        w = np.flatnonzero(own < free)
        moved[w, own[w]] = xlogx(total[own[w]]) - xlogx(total[own[w]] - n[w])
        gain -= moved
    return gain.argmax(axis=1)


def placed(cells: DataFrame, t: np.ndarray, free: int) -> DataFrame:
    """(h, n, cls): count and class of best gain, of the first ``free``, of every word of ``cells``."""
    shared = cells.sparkSession.sparkContext.broadcast(t)
    width = 2 * len(t) + 1

    def place(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        h, first, word = np.unique(rows["h"].to_numpy(), return_index=True, return_inverse=True)
        own = rows["own"].to_numpy()[first].astype(np.int64)
        word = np.repeat(word, pc.list_value_length(rows["cells"]).to_numpy())
        cell, n = (pc.list_flatten(rows[x]).to_numpy() for x in ("cells", "n"))
        for lo in range(0, len(h), PLACED):
            k = min(PLACED, len(h) - lo)
            at = slice(*np.searchsorted(word, [lo, lo + k]))
            counts = np.bincount((word[at] - lo) * width + cell[at], weights=n[at], minlength=k * width).reshape(k, width)
            cls = best_classes(own[lo:lo + k], counts, shared.value, free)
            total = counts[:, :len(shared.value)].sum(axis=1) + counts[:, -1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[lo:lo + k]), pa.array(total.astype(np.int64)), pa.array(cls, pa.int32())], ["h", "n", "cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                got = pa.Table.from_batches([b])
                held = got if held is None else pa.concat_tables([held, got])
                h = held["h"].to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last word may go on in the next batch
                if cut:
                    yield from place(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None:
            yield from place(held)

    return cells.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, n long, cls int")


def word_classes(training: DataFrame, known: pa.Table, clustered: int, classes: int) -> dict:
    """The model's words, from the ``numbered`` training texts: classes of the known ones, ``rest`` (h, n, cls) of all but the first, and
    from which count (``least``) all words are known."""
    top = min(clustered, known.num_rows)
    counts = transitions(training, known, top)
    first = exchange(counts, top, classes)
    c = classes + LOOKS + 1
    member = np.zeros((len(counts), c))
    member[np.arange(len(counts)), first] = 1
    n = known["n"].to_numpy()
    cls = np.concatenate([first[:top], classes + known["look"].to_numpy()[top:]]).astype(np.int64)
    cells = neighbour_classes(training, known, cls, top, classes, c)
    rest = materialize(placed(cells, member.T @ counts @ member, classes), "word-classes")
    least = int(n[-1]) if len(n) else 1 << 62
    if len(n) > top:
        got = rest.where(F.col("n") >= least).select("h", "cls").toArrow().sort_by("h")  # at most the known words
        at = np.searchsorted(got["h"].to_numpy(), hashes(known["word"].slice(top).to_pylist()))
        cls[top:] = got["cls"].to_numpy()[at]
    once = np.where(n == 1, (1 + known["look"].to_numpy().astype(np.int64)) * c, 0)
    return {"words": known["word"], "n": n, "cls": cls, "codes": cls + once, "top": top, "look0": classes, "edge": c - 1,
            "rest": rest, "least": least}


CODED = "rid long, doc_id long, n_tokens long, n_known long, base double, codes binary, pos int, h long"


def encoded(coded: DataFrame, model: dict, every: bool) -> DataFrame:
    """(doc_id, n_tokens, n_known, base, codes) of ``numbered`` texts: a document's class of every word
    (16 bits each; one seen once has c times its look, from 1, added) and the sum of its words' log10
    counts. ``every``: all training words are known, so none needs the join."""
    look0, c = model["look0"], model["edge"] + 1
    assert c * (LOOKS + 1) <= 1 << 16  # some 4 * 10^11 distinct words
    shared = coded.sparkSession.sparkContext.broadcast({k: model[k] for k in ("n", "codes")})
    names = [x.split()[0] for x in CODED.split(", ")]
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base", pa.float64()), ("codes", pa.binary()), ("pos", pa.int32()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        log_n = np.log10(m["n"] + ALPHA)

        def rare_rows(rid: list, pos: list, h: list) -> pa.RecordBatch:
            rid, pos, h = (np.concatenate(x) for x in (rid, pos, h))
            empty = [pa.nulls(len(rid), t) for t in schema.types[1:6]]
            return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), *empty, pa.array(pos, pa.int32()),
                                               pa.array(h, pa.int64())], schema=schema)

        for b in batches:
            docs_, rare = ([], [], [], []), ([], [], [])
            for rid, x, h in zip(b.column("rid").to_pylist(), b.column("ids"), b.column("rare")):
                ids = np.frombuffer(x.as_buffer(), "<i4")
                unknown = ids < 0
                own, code = ids[~unknown], np.empty(len(ids), "<u2")
                code[~unknown] = m["codes"][own]
                code[unknown] = look0 - 1 - ids[unknown]
                base = log_n[own].sum() + unknown.sum() * log10(ALPHA)
                for out, v in zip(docs_, (len(ids) + 1, len(own), base, code.tobytes())):
                    out.append(v)
                if not every:
                    pos = np.flatnonzero(unknown)
                    for out, v in zip(rare, (np.full(len(pos), rid), pos, np.frombuffer(h.as_buffer(), "<i8"))):
                        out.append(v)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("doc_id"),
                 *(pa.array(x, t) for x, t in zip(docs_, schema.types[2:6])),
                 pa.array(np.full(k, -1), pa.int32()), pa.nulls(k, pa.int64())], schema=schema)
            if rare[0]:
                yield rare_rows(*rare)

    rows = materialize(coded.mapInArrow(run, CODED), "coded")
    whole = rows.where("pos < 0").select(*names[:6])
    if every:
        return whole.drop("rid")
    rest = model["rest"].where(F.col("n") < model["least"]).select(F.col("h").alias("vh"), "cls", "n")
    found = (rows.where("pos >= 0").select("rid", "pos", "h").join(rest, F.col("h") == F.col("vh"))
             .groupBy("rid").agg(F.collect_list(F.struct("pos", "cls", "n")).alias("found")))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, base, known = [], [], []
            for code, s, k, got in zip(*(b.column(x) for x in ("codes", "base", "n_known", "found"))):
                code, s, k = np.frombuffer(code.as_py(), "<u2"), s.as_py(), k.as_py()
                if got.is_valid:
                    pos, cls, n = (got.values.field(x).to_numpy() for x in range(3))
                    code = code.copy()
                    code[pos] = np.where(n == 1, cls + c * (1 + code[pos].astype(np.int64) - look0), cls)
                    s += (np.log10(n + ALPHA) - log10(ALPHA)).sum()
                    k += len(pos)
                codes.append(code.tobytes())
                base.append(s)
                known.append(k)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_tokens"), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(codes, pa.binary())], ["doc_id", "n_tokens", "n_known", "base", "codes"])

    return materialize(whole.join(found, "rid", "left").mapInArrow(
        mend, "doc_id long, n_tokens long, n_known long, base double, codes binary"), "coded-whole")


def _pairs(codes: bytes, edge: int, look0: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of neighbouring words; with ``look0``, words seen once are in the class of their look."""
    once, inner = np.divmod(np.frombuffer(codes, "<u2").astype(np.int64), edge + 1)
    if look0 is not None:
        inner = np.where(once > 0, look0 - 1 + once, inner)
    return np.concatenate([[edge], inner]), np.concatenate([inner, [edge]])


def fitted(words: dict, coded: DataFrame) -> dict:
    """The model: ``words`` with log10 transitions, counted on the ``coded`` training documents, and
    each class's log10 emission divisor."""
    edge, look0, top = words["edge"], words["look0"], words["top"]
    c = edge + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(c * c, np.int64)
        for b in batches:
            left, right = zip(*(_pairs(x, edge, look0) for x in b["codes"])) if len(b) else ((), ())
            if left:
                total += np.bincount(np.concatenate(left) * c + np.concatenate(right), minlength=c * c)
        cell = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cell, "n": total[cell]})

    cells = (coded.select("codes").mapInPandas(run, "cell long, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())  # at most c^2 rows
    t = np.zeros(c * c)
    t[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    t = t.reshape(c, c)
    unigram = (t.sum(axis=0) + 1) / (t.sum() + c)
    trans = np.log10((t + KAPPA * unigram) / (t.sum(axis=1, keepdims=True) + KAPPA))
    # words and tokens of each class
    tokens_, types = np.zeros(c), np.zeros(c)
    for r in words["rest"].groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens_[r["cls"]], types[r["cls"]] = r["n"], r["v"]
    np.add.at(tokens_, words["cls"][:top], words["n"][:top])
    np.add.at(types, words["cls"][:top], 1)
    return words | {"trans": trans, "divisor": np.log10(tokens_ + ALPHA * (types + 1))}


def class_model(training: DataFrame, vocabulary: DataFrame, known: pa.Table,
                clustered: int = CLUSTERED, classes: int = CLASSES) -> dict:
    """Arrays of the model: class of each known word, log10 transitions, and each class's log10
    emission divisor; ``rest`` has the class of every other training word."""
    every = known.num_rows == vocabulary.count()
    coded = numbered(training, known, every)
    words = word_classes(coded, known, clustered, classes)
    return fitted(words, encoded(coded, words, every))


def scores(docs: DataFrame, held_out, clustered: int = CLUSTERED, classes: int = CLASSES,
           known_words: int = KNOWN) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (unigram with added ``ALPHA``) and score (class model), both log10.

    ``held_out`` is a condition on doc_id; the other rows train. ``classes`` and ``clustered`` grow
    with the vocabulary from the values given.
    """
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    training = docs.where(~held_out)
    vocabulary = materialize(word_counts(training), "vocabulary")
    n_docs = training.count()
    n_words, n_types = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    known, _ = frequent(vocabulary, known_words)
    if (grown := ceil(n_types ** 0.25)) > classes:
        clustered, classes = max(clustered, LEADERS * grown), grown
    every = known.num_rows == n_types
    ids = numbered(docs, known, every)
    words = word_classes(ids.where(~held_out), known, clustered, classes)
    coded = encoded(ids, words, every)
    model = fitted(words, coded.where(~held_out))
    shared = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("trans", "divisor", "edge")})
    total = n_words + n_docs
    divisor = log10(total + ALPHA * (n_types + (n_docs > 0) + 1))

    def run(base: pd.Series, codes: pd.Series) -> pd.Series:
        m, out = shared.value, []
        for s, x in zip(base, codes):
            left, right = _pairs(x, m["edge"])
            out.append(s + m["trans"][left, right].sum() - m["divisor"][left[1:]].sum())
        return pd.Series(out, dtype="float64")

    end = log10(n_docs + ALPHA)
    return coded.select(
        "doc_id", held_out.alias("held_out"), "n_tokens",
        (F.col("n_known") + (1 if n_docs else 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end) - F.col("n_tokens") * F.lit(divisor)).alias("base_score"),
        F.pandas_udf(run, "double")("base", "codes").alias("score"))


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those with crc32(id) mod 10 = 0 are held out."""
    return scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)
