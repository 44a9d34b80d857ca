"""Language identification by segmentation-marginalised unigrams over a fixed vocabulary.

Each language has a probability for every piece of a public vocabulary of byte
strings (all of it, and all single bytes). The probability of a text is the sum,
over all ways to cut it into pieces, of the product of the pieces'
probabilities; a forward pass over the bytes gives the sum. Pieces do not
cross word ends, so a text's value is the product of its words', and a task
runs the forward pass once for each different word it meets.

Words are runs of letters in lower case after a blank; runs of more than
``RUN`` letters are cut there, the parts after the first without a blank.
Learning is expectation maximisation from equal probabilities: words and their
numbers are counted in the tasks and summed by (language, word); each round
adds up, over all different words, the expected number of times each piece is
used (forward and backward pass), in fixed point, so the sums do not depend on
their order. The driver holds one number a (language, piece).

Defined cases: a null text, or one without a letter, is ``und`` with score 0,
as are all texts if no language was learned; rows that repeat are predicted
once each; a null id is hashed as the empty text; training rows of null
language teach nothing; ties between languages go to the first by code
point; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.llm.common import crc_mod, table, text_or_empty
from waypoint.session import materialize

#: Letters of a word part at most; bytes of a stretch that is looked up as one integer (longer ones go on byte by byte).
RUN, PIECE = 32, 8
#: Rounds of learning; what is added to a piece's expected number.
ROUNDS, ADDED = 2, 0.1
#: Fixed point of expected numbers.
UNIT = 1 << 16
#: Cells of a forward table, and words a task keeps, at most at a time.
CELLS, KEPT = 1 << 21, 400_000
LETTERS = re.compile(r"[^\W\d_]+")


class Pieces(list):
    """A vocabulary: a list of the pieces of at most PIECE bytes, and the ``longer`` ones.

    Pieces are numbered as listed, the number after them is for no piece, and the longer ones follow.
    """

    def __init__(self, pieces: list[bytes], longer: list[bytes] = ()):
        super().__init__(pieces)
        self.longer = list(longer)

    def __reduce__(self):
        return Pieces, (list(self), self.longer)


def pieces_of(path: str) -> Pieces:
    """The vocabulary of a rank file: its byte strings, and all single bytes."""
    with open(path, "rb") as f:
        found = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    found = list(dict.fromkeys(found + [bytes([b]) for b in range(256)]))
    return Pieces([p for p in found if len(p) <= PIECE], [p for p in found if len(p) > PIECE])


def longer_of(pieces: list[bytes]) -> list[bytes]:
    return getattr(pieces, "longer", [])


def numbered(pieces: list[bytes]) -> int:
    """How many numbers the pieces have, without the one for no piece."""
    return len(pieces) + len(longer_of(pieces))


def words_of(token: str) -> list[bytes]:
    """The words, and parts of long ones, in a stretch without white space."""
    out = []
    for run in LETTERS.findall(token.lower()):
        if not run.isalpha():  # numbers that are no digits
            parts = "".join(c if c.isalpha() else " " for c in run).split()
        else:
            parts = (run,)
        for part in parts:
            out += [(b" " if at == 0 else b"") + part[at:at + RUN].encode("utf-8", "surrogatepass")
                    for at in range(0, len(part), RUN)]
    return out


class Index:
    """Numbers of the pieces, looked up for many stretches at once: a stretch of up to 8 bytes is an
    integer, found in an open hash table of its length. The first 8 bytes of longer pieces are places of
    a tree (table ``HEAD``), from which each further byte leads on (table ``NEXT``: place * 256 + byte)."""

    FACTOR, HEAD, NEXT = np.uint64(0x9E3779B97F4A7C15), "head", "next"

    def __init__(self, pieces: list[bytes]):
        self.none, self.size = len(pieces), numbered(pieces)
        self.tables = {}
        for size in range(1, PIECE + 1):
            own = [i for i, p in enumerate(pieces) if len(p) == size]
            self._store(size, [int.from_bytes(pieces[i], "big") for i in own], own)
        head, step, self.piece_at = {}, {}, []
        for i, p in enumerate(longer_of(pieces)):
            at = head.setdefault(int.from_bytes(p[:PIECE], "big"), len(head) + len(step))
            for byte in p[PIECE:]:
                at = step.setdefault(at * 256 + byte, len(head) + len(step))
            self.piece_at += [self.none] * (at + 1 - len(self.piece_at))
            self.piece_at[at] = self.none + 1 + i
        places = len(head) + len(step)
        self.nowhere = places
        self.piece_at = np.array(self.piece_at + [self.none] * (places - len(self.piece_at)), np.int32)
        self._store(self.HEAD, list(head), list(head.values()), places)
        self._store(self.NEXT, list(step), list(step.values()), places)

    def _store(self, name, keys: list[int], numbers: list[int], none: int | None = None) -> None:
        none = self.none if none is None else none
        keys = np.array(keys, np.uint64)
        bits = max(8, (8 * len(keys)).bit_length())
        table = np.zeros(1 << bits, np.uint64), np.full(1 << bits, none, np.int32), np.uint64(64 - bits)
        for i, key, slot in zip(numbers, keys, (keys * self.FACTOR >> table[2]).astype(np.int64).tolist()):
            while table[1][slot] != none:
                slot = (slot + 1) % len(table[1])
            table[0][slot], table[1][slot] = key, i
        self.tables[name] = table

    def find(self, size, keys: np.ndarray) -> np.ndarray:
        """Numbers of stretches of ``size`` bytes, or places by ``HEAD`` or ``NEXT``; ``none`` (``nowhere``) if not found."""
        held, number, shift = self.tables[size]
        none = self.nowhere if size in (self.HEAD, self.NEXT) else self.none
        slot = (keys * self.FACTOR >> shift).astype(np.int64)
        out = number[slot]
        left = np.flatnonzero((held[slot] != keys) & (out != none))  # another key is in the slot
        out[left] = none
        slot = slot[left]
        while len(left):
            slot = (slot + 1) % len(held)
            same = (held[slot] == keys[left]) & (number[slot] != none)
            out[left[same]] = number[slot[same]]
            go_on = ~same & (number[slot] != none)
            left, slot = left[go_on], slot[go_on]
        return out


def spans(words: list[bytes], size: int, index: Index) -> np.ndarray:
    """Piece of every stretch of words of ``size`` bytes: [end - 1, length - 1, word]; none is ``index.none``.

    Lengths go to PIECE, or the longest piece that is found.
    """
    most = min(size, PIECE)
    raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size).T.astype(np.uint64)
    out = np.full((size, most, len(words)), index.none, np.int32)
    keys = np.zeros_like(raw)
    for n in range(1, most + 1):  # keys: of the stretches of n bytes, by their last byte
        keys = keys[n > 1:] | raw[:size - n + 1] << np.uint64(8 * (n - 1))
        out[n - 1:, n - 1] = index.find(n, keys.ravel()).reshape(keys.shape)
    if size <= PIECE or not len(index.piece_at):
        return out
    # stretches that begin like a longer piece: few, followed byte by byte
    place = index.find(index.HEAD, keys.ravel())
    on = np.flatnonzero(place != index.nowhere)
    place, (begin, word) = place[on].astype(np.uint64), np.divmod(on, len(words))
    n, found = PIECE, []
    while len(place):
        n += 1
        inside = begin + n <= size
        place, begin, word = place[inside], begin[inside], word[inside]
        place = index.find(index.NEXT, place * np.uint64(256) + raw[begin + n - 1, word])
        here = place != index.nowhere
        place, begin, word = place[here].astype(np.uint64), begin[here], word[here]
        piece = index.piece_at[place.astype(np.int64)]
        whole = piece != index.none
        if whole.any():
            found.append((n, begin[whole], word[whole], piece[whole]))
    if found:
        more = np.full((size, found[-1][0] - most, len(words)), index.none, np.int32)
        out = np.concatenate([out, more], axis=1)
        for n, begin, word, piece in found:
            out[begin + n - 1, n - 1, word] = piece
    return out


def _log_pass(p: np.ndarray, back: bool) -> np.ndarray:
    """``_pass`` in logs throughout, for values too far apart to be held in one scale."""
    size, most = p.shape[:2]
    out = np.zeros((size + 1, *p.shape[2:]))
    with np.errstate(divide="ignore"):
        p = np.log(p)
    for step in range(1, size + 1):
        at = size - step if back else step
        ways = [p[at + n - 1 if back else at - 1, n - 1] + out[at + n if back else at - n] for n in range(1, min(step, most) + 1)]
        out[at] = np.logaddexp.reduce(ways)
    return out


def _pass(p: np.ndarray, back: bool) -> np.ndarray:
    """Log of the summed probabilities of all segmentations up to every byte (``back``: from it to the end),
    from the probabilities of the stretches [end, length, word, ...]; single bytes are never 0."""
    size, most = p.shape[:2]
    if most > PIECE and p[p > 0].min() ** float(most) < 1e-280:
        return _log_pass(p, back)
    out = np.zeros((size + 1, *p.shape[2:]))
    near, scale = [np.ones(p.shape[2:])], np.zeros(p.shape[2:])  # values of the last places, all in one scale
    for step in range(1, size + 1):
        x = np.zeros(p.shape[2:])
        for n in range(1, min(step, most) + 1):
            x += p[size - step + n - 1 if back else step - 1, n - 1] * near[-n]
        out[size - step if back else step] = np.log(x) + scale
        near = near[1 - most:] + [x] if most > 1 else [x]
        if step % 4 == 0:
            scale = scale + np.log(x)
            near = [v / x for v in near]
    return out


def forward(p: np.ndarray) -> np.ndarray:
    return _pass(p, False)


def backward(p: np.ndarray) -> np.ndarray:
    return _pass(p, True)


def by_length(words: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bytes, places) of groups of words of like length, of few enough cells."""
    places = defaultdict(list)
    for i, w in enumerate(words):
        places[len(w)].append(i)
    for size, at in places.items():
        step = max(1, CELLS // (size * min(size, PIECE) * width))
        for lo in range(0, len(at), step):
            yield size, np.array(at[lo:lo + step])


def word_scores(words: list[bytes], index: Index, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language (columns of ``prob``, a row a number of a piece)."""
    out = np.zeros((len(words), prob.shape[1]))
    for size, at in by_length(words, prob.shape[1]):
        out[at] = forward(prob[spans([words[i] for i in at], size, index)])[-1]
    return out


def expected(words: list[bytes], lang: np.ndarray, n: np.ndarray, index: Index, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in fixed point, [piece, language], by ``n`` occurrences of each word of a language."""
    none, langs = index.none, prob.shape[1]
    out = np.zeros((index.size + 1) * langs, np.int64)
    for size, at in by_length(words, 3):
        ids = spans([words[i] for i in at], size, index)
        own = lang[at]
        p = prob[ids, own]
        a, b = forward(p), backward(p)
        for length in range(1, ids.shape[1] + 1):
            piece = ids[length - 1:, length - 1]
            e, w = np.nonzero(piece != none)  # the stretch begins at e and ends at e + length
            share = p[e + length - 1, length - 1, w] * np.exp(a[e, w] + b[e + length, w] - a[-1, w])
            uses = np.rint(share * UNIT).astype(np.int64) * n[at[w]]
            np.add.at(out, piece[e, w].astype(np.int64) * langs + own[w], uses)
    return np.delete(out.reshape(-1, langs), none, axis=0)


def word_counts(training: DataFrame) -> DataFrame:
    """(lang, word, n) over the texts of ``training`` (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def rows() -> pa.RecordBatch:
            total: Counter = Counter()
            for lang, tokens in seen.items():
                for token, n in tokens.items():
                    for w in words_of(token):
                        total[lang, w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.binary()),
                 pa.array(list(total.values()), pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                seen[lang.as_py()].update(text.as_py().split())
                if sum(map(len, seen.values())) > KEPT:
                    yield rows()
        yield rows()

    parts = training.select("lang", "text").mapInArrow(run, "lang string, word binary, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def probabilities(uses: np.ndarray, none: int | None = None) -> np.ndarray:
    """Smoothed probabilities from expected uses [piece, language], with the row ``none`` (the last) for no piece."""
    p = (uses + ADDED) / (uses.sum(axis=0) + ADDED * len(uses))
    return np.insert(p, len(p) if none is None else none, 0, axis=0)


def learned(training: DataFrame, pieces: list[bytes], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, probabilities [piece, language], log shares of the documents) from (lang, text)."""
    training = training.where(F.col("lang").isNotNull())
    words = materialize(word_counts(training), "language-words")
    docs = {r["lang"]: r["n"] for r in training.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())  # as many as the labels have values
    size, none = numbered(pieces), len(pieces)
    prob = probabilities(np.zeros((size, len(langs))), none)
    if not langs:
        return [], prob, np.zeros(0)
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((pieces, langs, prob))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, langs, prob = shared.value
            index = Index(pieces)
            number = {x: i for i, x in enumerate(langs)}
            total = np.zeros((index.size, len(langs)), np.int64)
            for b in batches:
                own = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
                total += expected(b.column("word").to_pylist(), own, b.column("n").to_numpy(), index, prob)
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], ["cell", "n"])

        cells = (words.mapInArrow(run, "cell long, n long").groupBy("cell")
                 .agg(F.sum("n").alias("n")).toArrow())  # at most pieces x languages rows
        uses = np.zeros(size * len(langs))
        uses[cells["cell"].to_numpy()] = cells["n"].to_numpy() / UNIT
        prob = probabilities(uses.reshape(size, len(langs)), none)
        shared.unpersist()
    n = np.array([docs[x] for x in langs], np.float64)
    return langs, prob, np.log(n / n.sum())


class Scores(dict):
    """Stretch without white space to its place in a table of log probabilities, which grows by ``fill``."""

    def __init__(self, index: Index, prob: np.ndarray):
        super().__init__()
        self.index, self.prob, self.fresh = index, prob, []
        self.table = np.zeros((0, prob.shape[1] + 1))

    def __missing__(self, token: str) -> int:
        self.fresh.append(token)
        self[token] = n = len(self)
        return n

    def fill(self) -> np.ndarray:
        """The table (a row a token: log probabilities, and the number of its words) with the new tokens."""
        if self.fresh:
            each = [words_of(t) for t in self.fresh]
            words = list(dict.fromkeys(w for ws in each for w in ws))
            value = dict(zip(words, np.column_stack([word_scores(words, self.index, self.prob), np.ones(len(words))])))
            new = np.zeros((len(each), self.table.shape[1]))
            for row, ws in zip(new, each):
                for w in ws:
                    row += value[w]
            self.table = np.concatenate([self.table, new])
            self.fresh = []
        return self.table

    def trim(self) -> None:
        if len(self) > KEPT:
            self.clear()
            self.table = self.table[:0]


def predicted(docs: DataFrame, pieces: list[bytes], langs: list[str], prob: np.ndarray, prior: np.ndarray,
              keep: list[str]) -> DataFrame:
    """``keep`` and lang_pred, score of ``docs`` (text): the likeliest language and its share of the probability."""
    shared = docs.sparkSession.sparkContext.broadcast((pieces, langs, prob, prior))
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*keep).schema}
    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs, prob, prior = shared.value
        scores = Scores(Index(pieces), prob)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pred, score = ["und"] * part.num_rows, [0.0] * part.num_rows
                if langs:
                    tokens = [list(map(scores.__getitem__, t.split())) for t in part.column("text").to_pylist()]
                    rows = scores.fill()
                    for i, own in enumerate(tokens):
                        total = rows[own].sum(axis=0)
                        if total[-1]:
                            x = total[:-1] + prior
                            best = int(x.argmax())
                            pred[i], score[i] = langs[best], float(1 / np.exp(x - x[best]).sum())
                    scores.trim()
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                    [*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def identify(docs: DataFrame, held_out: Column, vocabulary: str, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of ``docs`` (doc_id, text, lang), learned from those not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
                       F.col("lang").cast("string").alias("lang"), held_out.alias("held_out"))
    pieces = pieces_of(vocabulary)
    langs, prob, prior = learned(docs.where(~F.col("held_out")), pieces, rounds)
    return predicted(docs, pieces, langs, prob, prior, ["doc_id", "held_out"])


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; those with crc32(id) mod 5 = 0 are held out."""
    import public_tokenizers
    return identify(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0,
                    public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
