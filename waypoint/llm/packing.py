"""Hierarchical multi-length packing of tokenised documents.

A document's ids (with a closing 0) are cut into whole windows of the largest
context size, and a rest that is routed to the smallest tier that holds it.
Each tier packs its rests into windows of its size, longest first; a gap in a
longer window is filled with pieces of shorter tiers, the last of them cut to
fit. Windows that stay open at the end of a task are cut to powers of two, so
they need no padding either. Whole windows wait for the packed ones; after each
packing the sequences of a length are dealt to full step groups by attention cost (sum
of squared piece lengths), the next costliest always to the group with the
least so far; what fills no group waits for the next deal, so a task has at
most one smaller group of each length, at its end.

Packing needs no key to be together, so it runs where the scan put the rows:
no shuffle, one streaming pass, and at most ``pool`` rests and ``dealt`` whole
windows (as places and checksums, without ids) held in a task.
Sequence ids carry the partition number; a retried task reads the same split
and writes the same rows.

Defined cases: null texts are empty and give the single id 0; repeated rows
are packed once each; a null id stays null; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.llm.common import table, text_or_empty

TIERS = (1024, 512, 256)
#: Rests a task collects before it packs them.
POOL = 8192
#: Sequences of a step group, and whole windows that wait at most for the packed ones.
GROUP, DEALT = 8, 1 << 16

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, window long, step_group long")


#: Fixed values of byte-level BPE files: the split pattern, and the printable stand-ins of bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_level_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks by bytes, ids of special tokens) of a byte-level BPE tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("not a plain byte-level BPE file")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    rest = [b for b in range(256) if b not in PRINTABLE]
    to_byte = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}
    return {bytes(map(to_byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()
            if t not in special}, special


#: The characters of the pattern's \\s, and runs of them that the encoder's pattern engine has no stack for.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 10_000
LONG_BLANKS = re.compile(f"(?<![{BLANK}])[{BLANK}]{{{LONG_RUN},}}")


def long_blanks(text: str, stops: tuple[str, ...] = ()) -> Iterator[tuple[str, bool]]:
    """(part, is a long blank run) in order. By the split pattern a run leaves its last character to
    the text after it, unless the text ends there or a special token (``stops``) follows."""
    half = LONG_RUN // 2  # a long run fills one such block at least
    at = 0
    if any(text[i:i + half].isspace() for i in range(0, len(text), half)):
        for m in LONG_BLANKS.finditer(text):
            end = m.end() if m.end() == len(text) or text.startswith(stops, m.end()) else m.end() - 1
            yield text[at:m.start()], False
            yield text[m.start():end], True
            at = end
    yield text[at:], False


class FileTokenizer:
    """Ids of whole texts, as the tokenizer file gives them without added special tokens.

    The file's vocabulary is its merge order, so the same ids come from an
    encoder over ranks, which is several times faster (tests compare both).
    A special token's string in a text is that token, as in the file's library;
    with ``plain`` it is ordinary text.
    """

    def __init__(self, path: str):
        import tiktoken
        self.ranks, self.special = byte_level_ranks(path)
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=self.ranks,
                                     special_tokens=self.special)

    def ids(self, text: str, plain: bool = False) -> np.ndarray:
        special = () if plain else tuple(s for s in self.special if s in text)
        out = []
        for part, blank in long_blanks(text, special):
            if blank:
                out.append(self._blank_ids(part))
            elif special:
                out.append(np.array(self.bpe.encode(part, allowed_special="all"), np.uint32))
            else:
                out.append(np.array(self.bpe.encode_ordinary(part), np.uint32))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def _blank_ids(self, run: str) -> np.ndarray:
        """Ids of one piece of the split pattern, without the pattern."""
        return np.array(self.bpe._encode_single_piece(run), np.uint32)


class Packer:
    """Streams (doc_id, ids) into rows of SCHEMA; see the module text."""

    def __init__(self, part: int, tiers=TIERS, pool: int = POOL, group: int = GROUP, dealt: int = DEALT):
        self.tiers, self.limit, self.group = sorted(tiers, reverse=True), pool, group
        self.dealt = max(dealt, group)
        self.base = self.step = part << 40
        self.next = self.base
        self.rests: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.ready = defaultdict(list)  # length: (cost, rows up to the sequence id) of sequences without a group
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        size, n = self.tiers[0], len(ids)
        cut = n - n % size
        self._emit([(size, [(doc_id, s, ids[s:s + size], n)]) for s in range(0, cut, size)])
        if cut < n:
            self.rests.append((doc_id, cut, ids[cut:], n))
        if len(self.rests) >= self.limit:
            self.pack(last=False)
        self._deal_full(self.dealt)

    def pack(self, last: bool) -> None:
        """Packs the rests; without ``last``, pieces of open windows wait for the next round."""
        queue = {t: [] for t in self.tiers}
        for p in sorted(self.rests, key=lambda p: len(p[2])):  # pop() takes the longest
            queue[min(t for t in self.tiers if t >= len(p[2]))].append(p)
        self.rests, made = [], []
        for i, tier in enumerate(self.tiers):
            while queue[tier]:
                window, room = [], tier
                for t in self.tiers[i:]:  # own tier first, then gaps from the shorter ones
                    while queue[t] and room:
                        doc, start, ids, n = queue[t].pop()
                        window.append((doc, start, ids[:room], n))
                        if len(ids) > room:  # cut to fit; what is left goes down the tiers
                            rest = (doc, start + room, ids[room:], n)
                            low = min(x for x in self.tiers if x >= len(rest[2]))
                            self._put(queue[low], rest)
                        room -= len(window[-1][2])
                if not room:
                    made.append((tier, window))
                elif last:
                    made += self._powers(window)
                else:
                    self.rests += window
        self._emit(made)
        self._deal_full(self.group)
        if last:
            for size in sorted(self.ready, reverse=True):
                self._deal(size, len(self.ready[size]))

    @staticmethod
    def _put(queue: list, piece: tuple) -> None:
        """Keeps the queue sorted by length."""
        lo, hi, n = 0, len(queue), len(piece[2])
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if len(queue[mid][2]) < n else (lo, mid)
        queue.insert(lo, piece)

    @staticmethod
    def _powers(window: list) -> list:
        """The window's pieces as sequences of powers of two, longest first."""
        out, pieces = [], list(window)
        left = sum(len(p[2]) for p in pieces)
        while left:
            size = room = 1 << (left.bit_length() - 1)
            seq = []
            while room:
                doc, start, ids, n = pieces.pop(0)
                seq.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:], n))
                room -= len(seq[-1][2])
            out.append((size, seq))
            left -= size
        return out

    def _emit(self, made: list) -> None:
        for size, seq in made:
            rows = [(doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n) for doc, start, ids, n in seq]
            self.ready[size].append((sum(x[2] ** 2 for x in rows), rows))

    def _deal_full(self, least: int) -> None:
        """Deals what fills groups, of the lengths that have ``least`` ready sequences."""
        for size in sorted(self.ready, reverse=True):
            k = len(self.ready[size])
            if k >= least:
                self._deal(size, k - k % self.group)

    def _deal(self, size: int, k: int) -> None:
        """Deals the first ``k`` ready sequences of a length to step groups."""
        seqs, self.ready[size] = self.ready[size][:k], self.ready[size][k:]
        groups = [(0, self.step + g) for g in range(-(-k // self.group))]
        self.step += len(groups)
        heapq.heapify(groups)
        held = defaultdict(int)
        for cost, rows in sorted(seqs, key=lambda s: -s[0]):
            c, g = heapq.heappop(groups)
            held[g] += 1
            if held[g] < self.group:
                heapq.heappush(groups, (c + cost, g))
            offset = 0
            for row in rows:
                self.rows.append((*row, self.next, offset, size, g))
                offset += row[2]
            self.next += 1

    def take(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        self.rows = []
        return out.astype({"doc_id": "Int64"})


def pack(docs: DataFrame, tokenizer_path: str, tiers=TIERS, pool: int = POOL, group: int = GROUP,
         id_col: str = "doc_id") -> DataFrame:
    """Pieces of ``docs`` (SCHEMA): every id of every document in exactly one piece.

    ``window`` is the sequence's length with padding (a tier, or the power of
    two it fills exactly); ``step_group`` joins sequences of like length.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = FileTokenizer(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId(), tiers, pool, group)
        end = np.zeros(1, np.uint32)
        for b in batches:
            ids = [None if pd.isna(i) else int(i) for i in b["doc_id"]]
            for doc, text in zip(ids, b["text"]):
                packer.add(doc, np.concatenate([tok.ids(text), end]))
                if len(packer.rows) >= 20_000:
                    yield packer.take()
            yield packer.take()
        packer.pack(last=True)
        yield packer.take()

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
