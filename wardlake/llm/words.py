"""Words and word windows of many texts at once, as 64-bit hashes in numpy.

A word is a maximal run of bytes other than space and the five ASCII control
spaces (9 to 13). Word and window hashes come from prefix sums of a polynomial
modulo 2**64, so every window of one batch costs two look-ups, whatever its
length, and equal sequences hash alike in every document, task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text worked on at once, unless one text alone is longer.
CHUNK_BYTES = 500_000

_U = np.uint64
_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_BYTE = np.random.Generator(np.random.PCG64(20_11)).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    kept = _cache.get(base)
    if kept is None or len(kept[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for x in (base, pow(base, -1, 2**64)):
            steps = np.full(size, x, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        kept = (both[0], both[1])
        if size <= 4 * CHUNK_BYTES:
            _cache[base] = kept
    return kept[0][:n], kept[1][:n]


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values))[0], out=total[1:])
    return total


class Words:
    """The words of consecutive texts: ``first[d]`` is the first word of text d."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(values)
        if lower:
            values = _LOWER[values]
        self.offsets = offsets
        inside = ~SPACE[values]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        filled = offsets[:-1] < offsets[1:]
        heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
        begin[heads] = inside[heads]
        end[tails] = inside[tails]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        total = _prefix(_BYTE[values], _FIRST)
        inverse = _powers(_FIRST, n)[1]
        raw = (total[self.ends] - total[self.starts]) * inverse[self.starts] if n else np.zeros(0, dtype=np.uint64)
        self.hash = mix(raw ^ (self.ends - self.starts).astype(np.uint64))
        self._sums: dict[int, np.ndarray] = {}

    def spans(self, start: np.ndarray, stop: np.ndarray, base: int = _FIRST) -> np.ndarray:
        """Hashes of the word sequences [start, stop) of the batch, length included."""
        if base not in self._sums:
            self._sums[base] = _prefix(self.hash if base == _FIRST else mix(self.hash), base)
        total, inverse = self._sums[base], _powers(base, len(self.hash) + 1)[1]
        return mix(mix((total[stop] - total[start]) * inverse[start]) + (stop - start).astype(np.uint64))

    def pair(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes: 128 bits."""
        return self.spans(start, stop), self.spans(start, stop, _SECOND)


def binary_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text or binary column as binary, nulls as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return column.fill_null(b"") if column.null_count else column


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of slices of a binary column."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, to, values[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's longs."""
    return x.view(np.int64)


def list_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One list per text from consecutive values and counts."""
    ends = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


#: Stands for a NULL document key; sorts first.
NO_KEY = -(2**63)
#: Keys of wanted documents are broadcast up to this many (some 90 MB as a hash table).
BROADCAST_KEYS = 500_000


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc (never NULL), dh (hash of the text) and text."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("dh"), F.col(text).alias("text"))


def packed(rows: DataFrame) -> DataFrame:
    """doc, dh and the text of ``keyed`` rows compressed: what is shuffled when texts must move."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                raw = [pack.compress(x) for x in binary_column(some, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(raw, pa.binary())], ["doc", "dh", "ztext"])

    return rows.mapInArrow(work, "doc long, dh long, ztext binary")


def texts_of(docs: DataFrame, key: str, text: str, wanted: DataFrame, pack: bool = True) -> DataFrame:
    """``packed`` texts of the documents in ``wanted`` (a stored table with doc, dh).

    Few enough keys are sent to the scan and only wanted texts leave it; beyond
    that bound all texts meet their keys in a shuffle. Without ``pack`` texts that
    were not shuffled come as they are, for a caller that reads them in the same
    stage: two Python steps in one task would hold two workers.
    """
    keys = wanted.select("doc", "dh")
    rows = keyed(docs, key, text)
    if keys.count() <= BROADCAST_KEYS:
        found = rows.join(F.broadcast(keys.distinct()), ["doc", "dh"], "left_semi")
        return packed(found) if pack else found
    return packed(rows).join(keys.distinct(), ["doc", "dh"], "left_semi")


def unpacked(batch: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch of ``texts_of`` rows."""
    if "ztext" not in batch.schema.names:
        return binary_column(batch, "text").to_pylist()
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(z) for z in batch.column(batch.schema.get_field_index("ztext")).to_pylist()]


def in_parts(batch: pa.RecordBatch, rows: int = 64, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """A few rows of a batch of ``texts_of`` rows at a time, with their words."""
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        raw = unpacked(part)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        yield part, Words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, lower)
