"""Exact byte-level BPE by longest matches and backtracking, without running merges.

A piece of text is covered from left to right with the longest vocabulary entry
at each place. Two neighbours are allowed when merging their joined bytes by
rank gives exactly these two, which is decided by undoing merges from the
boundary outwards and remembered per pair. A neighbour that is not allowed is
shortened to its next shorter prefix entry; without one, the last token is taken
back and its end marked dead, so every end is left for good at most once and the
work is linear in the bytes. The result is the one the merges give.

Matches come from one Aho-Corasick automaton over the entries with bytes mapped
to Latin-1 characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries kept by one worker before a memo starts anew.
MEMO_PIECES, MEMO_PAIRS = 400_000, 2_000_000
#: Pieces longer than this are not remembered.
MEMO_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class BytePairs:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.bytes_of = {rank: b for b, rank in ranks.items()}
        self.length = {rank: len(b) for b, rank in ranks.items()}
        #: next shorter entry that starts the entry, or None
        self.shorter: dict[int, int | None] = {}
        #: the two entries whose merge makes the entry; itself twice if none do
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.allowed: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for b, rank in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), rank)
            self.shorter[rank] = next((ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in ranks), None)
        for b, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.halves[rank] = self._halve(b, rank)
            if self.halves[rank][0] != rank:
                self.joined[self.halves[rank]] = rank
        self.automaton.make_automaton()
        self.allowed.clear()

    def _halve(self, b: bytes, rank: int) -> tuple[int, int]:
        left = self.shorter[rank]
        while left is not None:
            right = self.ranks.get(b[self.length[left] :])
            if right is not None and left < rank and right < rank and self._undo(left, right):
                return left, right
            left = self.shorter[left]
        return rank, rank

    def _undo(self, left: int, right: int) -> bool:
        """Whether no merge across the boundary comes before the merges that made both sides."""
        bound = None  # merges at or above it come too late to matter
        while True:
            over = self.joined.get((left, right))
            if over is not None and (bound is None or over < bound):
                return False
            # take apart the side that was merged last; an entry without halves passes its turn on
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left" and self.halves[left][1] != left:
                    bound, left = left, self.halves[left][1]
                    break
                if side == "right" and self.halves[right][0] != right:
                    bound, right = right + 1, self.halves[right][0]
                    break
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.allowed.get(pair)
        if known is None:
            if len(self.allowed) > MEMO_PAIRS:
                self.allowed.clear()
            known = self.allowed[pair] = self._undo(left, right)
        return known

    def tokens(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest: list[int | None] = [None] * n
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end - self.length[rank] + 1] = rank  # later ends are longer
        out: list[int] = []
        alive = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            placed = False
            while token is not None:
                end = at + self.length[token]
                if alive[end] and (not out or self.fits(out[-1], token)):
                    placed = True
                    break
                token = self.shorter[token]
            if placed:
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                alive[at] = 0
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        memo, parts = self.memo, []
        for piece in self.pattern.findall(text):
            ids = memo.get(piece)
            if ids is None:
                ids = np.array(self.tokens(piece.encode()), dtype="<u4").tobytes()
                if len(piece) <= MEMO_BYTES:
                    if len(memo) > MEMO_PIECES:
                        memo.clear()
                    memo[piece] = ids
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_models: dict[tuple[str, str], BytePairs] = {}


def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One per worker process."""
    if (path, pattern) not in _models:
        _models[path, pattern] = BytePairs(read_ranks(path), pattern)
    return _models[path, pattern]


def _over_binary(df: DataFrame, value: Column, name: str, work) -> DataFrame:
    """The rows with a binary column ``name`` made by ``work`` from ``value``; a column of that name is replaced."""
    rest = [c for c in df.columns if c != name]
    schema = df.select(*rest, value.alias(name)).withColumn(name, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = work()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                made = pa.array([do(x) for x in some.column(some.num_columns - 1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], made], some.schema.names)

    return df.select(*rest, value.alias(name)).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows with ``ids`` in place of the text: little-endian 32-bit ids of the whole text (NULL: none)."""
    kept = docs.select(*[c for c in docs.columns if c not in (text, "ids")], F.col(text).alias("ids"))
    return _over_binary(kept, F.coalesce(F.col("ids"), F.lit("")), "ids", lambda: byte_pairs(path, pattern).encode)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows with ``decoded``: the bytes of the ids."""
    return _over_binary(encoded, F.coalesce(F.col("ids"), F.lit(b"")), "decoded", lambda: byte_pairs(path, pattern).decode)
