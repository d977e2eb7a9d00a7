"""Language-model scores from n-gram counts held in a log-frequency Bloom filter.

Counts are quantised to levels (Talbot and Osborne): an n-gram of level q is put
into the filter q times, once with each number from 1 to q, and read back by
probing 1, 2, ... until a probe misses. A level is never too low; it is too high
by one as often as a Bloom filter errs. The probability of a token is

    P1(w)   = (c(w) + ADD) / (N + ADD * (V + 1))
    P(w|h)  = (min(c(hw), c(h)) + PRIOR * P(w|h')) / (c(h) + PRIOR)

with every c read from the filter, h the tokens before w (a mark for the start of
the text included) and h' the same without its first one: Dirichlet smoothing,
order by order. N tokens and V distinct ones are counted exactly, and so are the
counts of the unigram score that is given beside it.

The filter consists of segments by hash, each as large as its own n-grams need
and built by a task of its own; their number follows the number of tokens. Up to
``BROADCAST_BYTES`` all segments are broadcast. A filter beyond that stays where it
is, and the distinct n-grams of each chunk of texts go to their segments and come
back with their levels: the same levels, so the same scores.

Words are known by 64-bit hashes; two of 10**8 different ones share one with a
probability of 0.0003.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.shared import Scratch
from wardlake.llm.words import Words, binary_column, chunks, mix

ORDER = 2
#: Added to every unigram count; weight of the shorter context against the longer one.
ADD, PRIOR = 0.1, 50.0
#: Ratio of neighbouring levels, bits per inserted item, bits set by an item.
RATIO, BITS, PROBES = 1.25, 10, 6
#: Texts of one chunk (one document at least), words counted and n-grams held by one task at about.
CHUNK_BYTES, PART_WORDS, SEGMENT_GRAMS = 4_000_000, 2_000_000, 2_000_000
#: Hashes probed at once; different n-grams a task holds before it passes them on.
PROBED_KEYS, HELD_GRAMS = 250_000, 1_000_000
#: The filter is broadcast up to this size.
BROADCAST_BYTES = 128_000_000

_U = np.uint64
END, START = _U(0x2545F4914F6CDD1D), _U(0x9E6C63D0876A9A47)
_STEP = 0xD6E8FEB86659FD93


def _levels() -> np.ndarray:
    """Smallest count of each level, from level 1."""
    out = [1]
    while out[-1] < 2**60:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out, dtype=np.int64)


LEVELS = _levels()
#: What a level stands for: the middle of its counts; level 0 is a count of 0.
VALUES = np.concatenate(([0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2))


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right")


# --- numbers and texts as compressed columns ----------------------------------


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of equal weight, compressed."""
    planes = np.ascontiguousarray(values.astype(_U).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(_U).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return packed(np.diff(keys, prepend=_U(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=_U)


CHUNK = "chunk long, ids array<long>, train array<boolean>, sizes array<long>, n_words long, texts binary"


def text_chunks(docs: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    """Whole texts of consecutive rows, some 4 MB in one row, compressed; to be written before use.

    The number of a chunk is that of its task and its place there.
    """
    kinds = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("n_words", pa.int64()), ("texts", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        ids, marks, texts, size, made = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            raw = b"".join(texts)
            n = len(raw.split()) + len(texts)
            one = [task + made, ids, marks, [len(x) for x in texts], n, zstandard.ZstdCompressor(level=3).compress(raw)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(one, kinds, strict=True)], schema=kinds)

        for batch in batches:
            for k, mark, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_column(batch, "text"), strict=True):
                raw = x.as_py()
                if ids and size + len(raw) > CHUNK_BYTES:
                    yield row()
                    ids, marks, texts, size, made = [], [], [], 0, made + 1
                ids.append(k)
                marks.append(mark)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield row()

    rows = docs.select(docs[key].cast("long").alias("id"), F.coalesce(train, F.lit(True)).alias("train"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(work, CHUNK)


# --- tokens and n-grams of a chunk --------------------------------------------


class Tokens:
    """Tokens of the texts of a chunk: each text is START, its words, END."""

    def __init__(self, ids: list, train: list, sizes: list, texts: bytes):
        self.ids, self.train = ids, np.array(train, dtype=bool)
        raw = zstandard.ZstdDecompressor().decompress(texts)
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        column = pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
        hashes, counts = [], []
        for _, _, values, offsets in chunks(column):
            words = Words(values, offsets, lower=True)
            hashes.append(words.hash)
            counts.append(np.diff(words.first))
        n = np.concatenate(counts) + 2
        self.first = np.concatenate(([0], np.cumsum(n)))
        self.hash = np.empty(self.first[-1], dtype=_U)
        edge = np.zeros(len(self.hash), dtype=bool)
        edge[self.first[:-1]] = edge[self.first[1:] - 1] = True
        self.hash[~edge] = np.concatenate(hashes)
        self.hash[self.first[:-1]], self.hash[self.first[1:] - 1] = START, END
        self.doc = np.repeat(np.arange(len(n)), n)
        #: Everything but START is a token.
        self.token = np.ones(len(self.hash), dtype=bool)
        self.token[self.first[:-1]] = False
        self.n_tokens = n - 1

    def grams(self, order: int) -> list[np.ndarray]:
        """Hashes of the n-grams of 1, 2, ... tokens that end at each place; 0 where the text has begun later."""
        out, place = [self.hash], np.arange(len(self.hash)) - self.first[self.doc]
        for k in range(1, order):
            longer = np.zeros_like(self.hash)
            longer[1:] = mix(mix(out[-1][:-1] + _U(k)) + self.hash[1:])
            longer[place < k] = 0
            out.append(longer)
        return out


def _tokens(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, Tokens]]:
    for row in table.select(["chunk", "ids", "train", "sizes", "texts"]).to_pylist():
        yield row["chunk"], Tokens(row["ids"], row["train"], row["sizes"], row["texts"])


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts, a power of two, are ranges of hashes."""
    if parts == 1:
        return np.zeros(len(keys), dtype=np.int64)
    return (keys >> _U(64 - parts.bit_length() + 1)).astype(np.int64)


def _share(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted hashes."""
    found, begin = np.unique(_part_of(keys, parts), return_index=True)
    return zip(found.tolist(), begin.tolist(), [*begin.tolist(), len(keys)][1:], strict=True)


def _parts(n: int, each: int) -> int:
    return 1 << max(0, -(-n // each) - 1).bit_length()


BLOCK = "part long, chunk long, keys binary, counts binary"


def _blocks(per_chunk) -> object:
    """A step for mapInArrow: (part, keys, counts) rows that ``per_chunk`` gives for the tokens of each chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for chunk, tokens in _tokens(batch.slice(i, 1)):
                    rows = list(per_chunk(tokens))
                    if rows:
                        part, keys, counts = (list(x) for x in zip(*rows, strict=True))
                        arrays = [pa.array(part, pa.int64()), pa.array([chunk] * len(rows), pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())]
                        yield pa.RecordBatch.from_arrays(arrays, ["part", "chunk", "keys", "counts"])

    return work


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the sums of their weights (1 each by default)."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[begin], np.add.reduceat(weights, begin) if len(keys) else weights


# --- exact counts of words -------------------------------------------------------

KNOWN = "chunk long, kind int, part long, payload binary, words long, tokens long"


def word_counts(texts: DataFrame, parts: int) -> DataFrame:
    """Exact counts among training tokens of the distinct tokens of each chunk.

    Each chunk sends a distinct token once, so a frequent one is no hot key. One
    row per chunk and part holds the counts in the order of the hashes; a row
    without a chunk holds the number of distinct training tokens and of all.
    """

    def per_chunk(tokens: Tokens) -> Iterator[tuple[int, bytes, bytes]]:
        keys, of = np.unique(tokens.hash[tokens.token], return_inverse=True)
        counts = np.bincount(of, weights=tokens.train[tokens.doc[tokens.token]], minlength=len(keys))
        for part, a, b in _share(keys, parts):
            yield part, packed_keys(keys[a:b]), packed(counts[a:b])

    def total(group: pa.Table) -> pa.Table:
        keys = [unpacked_keys(x.as_py()) for x in group["keys"]]
        of = np.cumsum([0, *map(len, keys)])
        names, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(names), dtype=np.int64)
        np.add.at(sums, inverse, np.concatenate([unpacked(x.as_py()) for x in group["counts"]]).astype(np.int64))
        n = group.num_rows
        payload = [packed(sums[inverse[a:b]]) for a, b in zip(of[:-1], of[1:], strict=True)]
        columns = {
            "chunk": pa.array([*group["chunk"].to_pylist(), None], pa.int64()),
            "kind": pa.array([0] * (n + 1), pa.int32()),
            "part": pa.array([group["part"][0].as_py()] * (n + 1), pa.int64()),
            "payload": pa.array([*payload, None], pa.binary()),
            "words": pa.array([None] * n + [int((sums > 0).sum())], pa.int64()),
            "tokens": pa.array([None] * n + [int(sums.sum())], pa.int64()),
        }
        return pa.table(columns)

    return texts.mapInArrow(_blocks(per_chunk), BLOCK).groupBy("part").applyInArrow(total, KNOWN)


# --- the filter ------------------------------------------------------------------

SEGMENT = "part long, n_bits long, bits binary"


class _Turn:
    """Bits of the pairs of some hashes with one number."""

    def __init__(self, keys: np.ndarray, turn: int, n_bits: np.ndarray | int):
        self.a = mix(keys + _U(turn * _STEP % 2**64))
        self.b, self.n_bits = mix(self.a) | _U(1), np.broadcast_to(np.asarray(n_bits, dtype=_U), keys.shape)

    def spots(self, probe: int) -> np.ndarray:
        return ((self.a + _U(probe) * self.b) % self.n_bits).astype(np.int64)

    def only(self, some: np.ndarray) -> None:
        self.a, self.b, self.n_bits = self.a[some], self.b[some], self.n_bits[some]


def build_filter(texts: DataFrame, order: int, parts: int) -> DataFrame:
    """Segments with the levels of all n-grams of the training texts, one row each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def passed_on() -> pa.RecordBatch:
            keys, counts = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            rows = [(part, None, packed_keys(keys[a:b]), packed(counts[a:b])) for part, a, b in _share(keys, parts)]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "chunk", "keys", "counts"])

        for batch in batches:
            for i in range(batch.num_rows):
                for _, tokens in _tokens(batch.slice(i, 1)):
                    learnt = tokens.train[tokens.doc]
                    grams = np.concatenate([g[learnt & (g != 0)] for g in tokens.grams(order)])
                    held.append(_counted(grams))
                if sum(len(k) for k, _ in held) > HELD_GRAMS:
                    yield passed_on()
                    held.clear()
        if held:
            yield passed_on()

    def segment(group: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked_keys(x.as_py()) for x in group["keys"]])
        keys, counts = _counted(keys, np.concatenate([unpacked(x.as_py()) for x in group["counts"]]).astype(np.int64))
        levels = level(counts)
        n_bits = max(64, -(-int(levels.sum()) * BITS // 64) * 64)
        bits = np.zeros(n_bits, dtype=bool)
        turn = 1
        while len(keys):
            pairs = _Turn(keys, turn, n_bits)
            for probe in range(PROBES):
                bits[pairs.spots(probe)] = True
            more = levels > turn
            keys, levels, turn = keys[more], levels[more], turn + 1
        return pa.table({"part": group["part"][:1], "n_bits": pa.array([n_bits], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return texts.mapInArrow(work, BLOCK).groupBy("part").applyInArrow(segment, SEGMENT)


def levels_in(keys: np.ndarray, data: np.ndarray, begin: np.ndarray | int, n_bits: np.ndarray | int) -> np.ndarray:
    """Levels of hashes, by probes with 1, 2, ... until one misses; their segment begins at bit ``begin``."""
    begin, n_bits = np.broadcast_to(begin, keys.shape), np.broadcast_to(n_bits, keys.shape)
    if len(keys) > PROBED_KEYS:
        cuts = range(PROBED_KEYS, len(keys), PROBED_KEYS)
        parts = (np.split(x, cuts) for x in (keys, begin, n_bits))
        return np.concatenate([levels_in(k, data, b, n) for k, b, n in zip(*parts, strict=True)])
    out, open_, turn = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys)), 1
    while len(open_):
        pairs = _Turn(keys[open_], turn, n_bits[open_])
        for probe in range(PROBES):
            spot = begin[open_] + pairs.spots(probe)
            hit = (data[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
            open_ = open_[hit]
            pairs.only(hit)
        out[open_] = turn
        turn += 1
    return out


class Filter:
    """All segments side by side, as they are broadcast; filled one by one, so nowhere is a second copy of them."""

    def __init__(self, segments: DataFrame, parts: int, n_bytes: int):
        self.parts, self.data, at = parts, np.zeros(n_bytes + 8, dtype=np.uint8), 8
        # a part without a segment has one bit, which is not set
        self.begin, self.n_bits = np.zeros(parts, dtype=np.int64), np.ones(parts, dtype=_U)
        for part, n_bits, bits in segments.toLocalIterator():
            self.data[at : at + len(bits)] = np.frombuffer(bits, dtype=np.uint8)
            self.begin[part], self.n_bits[part] = 8 * at, n_bits
            at += len(bits)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        part = _part_of(keys, self.parts)
        return levels_in(keys, self.data, self.begin[part], self.n_bits[part])


def _levels_at_segments(texts: DataFrame, segments: DataFrame, order: int, parts: int) -> DataFrame:
    """Levels of the distinct n-grams of each chunk, looked up where the segments are."""

    def per_chunk(tokens: Tokens) -> Iterator[tuple[int, bytes, None]]:
        keys = np.unique(np.concatenate(tokens.grams(order)))
        for part, a, b in _share(keys, parts):
            yield part, packed_keys(keys[a:b]), None

    def look_up(blocks: pa.Table, segment: pa.Table) -> pa.Table:
        n = blocks.num_rows
        held = (np.frombuffer(segment["bits"][0].as_py(), dtype=np.uint8), 0, segment["n_bits"][0].as_py()) if segment.num_rows else None
        keys = [unpacked_keys(x.as_py()) for x in blocks["keys"]]
        every = np.concatenate(keys)  # probed together: a block alone is small
        levels = levels_in(every, *held) if held else np.zeros(len(every), dtype=np.int64)
        payload = [packed(x) for x in np.split(levels, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table({
            "chunk": blocks["chunk"],
            "kind": pa.array([1] * n, pa.int32()),
            "part": blocks["part"],
            "payload": pa.array(payload, pa.binary()),
            "words": pa.nulls(n, pa.int64()),
            "tokens": pa.nulls(n, pa.int64()),
        })

    blocks = texts.mapInArrow(_blocks(per_chunk), BLOCK)
    return blocks.groupBy("part").cogroup(segments.groupBy("part")).applyInArrow(look_up, KNOWN)


# --- scores ------------------------------------------------------------------------

SCORES = "id long, trained boolean, n_tokens long, n_known long, base_score double, score double"


def _in_order(table: pa.Table, kind: int) -> np.ndarray:
    rows = sorted((r["part"], r["payload"]) for r in table.select(["kind", "part", "payload"]).to_pylist() if r["kind"] == kind)
    return np.concatenate([unpacked(p) for _, p in rows]).astype(np.int64) if rows else np.zeros(0, dtype=np.int64)


def _probabilities(tokens: Tokens, order: int, n: int, v: int, levels) -> np.ndarray:
    """The model's probability of every place; ``levels`` gives the levels of distinct sorted hashes."""
    grams = tokens.grams(order)
    keys, of = np.unique(np.concatenate(grams), return_inverse=True)
    counts = VALUES[levels(keys)]
    counts[keys == 0] = 0
    c = counts[of].reshape(order, -1)
    p = (c[0] + ADD) / (n + ADD * (v + 1))
    for k in range(1, order):
        inside = grams[k] != 0
        before = np.zeros_like(p)
        before[1:] = c[k - 1][:-1]
        p = np.where(inside, (np.minimum(c[k], before) + PRIOR * p) / (before + PRIOR), p)
    return p


def score_documents(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, broadcast_bytes: int | None = None) -> tuple[DataFrame, int]:
    """Scores of all rows of ``docs`` (log10) by a model of those with ``train``, and the number of training tokens.

    Columns: ``id``, ``trained``, ``n_tokens`` (words and one end), ``n_known`` (tokens
    that training has), ``base_score`` (unigrams, exact counts), ``score``. NULL
    texts are empty and have one token, the end; a NULL ``train`` counts as true; a
    NULL key passes unchanged. Repeated rows are learnt and scored each. Other
    columns of ``docs`` are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    scratch = Scratch(spark, "lm")
    texts = scratch.write(text_chunks(docs, key, text, train), "texts")
    size = texts.agg(F.sum("n_words")).first()[0] or 0
    known = scratch.write(word_counts(texts, _parts(size, PART_WORDS)), "known")
    v, n = (x or 0 for x in known.agg(F.sum("words"), F.sum("tokens")).first())
    parts = _parts(size * order, SEGMENT_GRAMS)
    segments = scratch.write(build_filter(texts, order, parts), "filter")
    filter_bytes = segments.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    found = known.filter("chunk is not null")
    if filter_bytes <= limit:
        shared = spark.sparkContext.broadcast(Filter(segments, parts, filter_bytes))
    else:
        shared = None
        found = found.unionByName(scratch.write(_levels_at_segments(texts, segments, order, parts), "levels"))

    def one(chunk: pa.Table, looked_up: pa.Table) -> pa.Table:
        out = []
        counts = _in_order(looked_up, 0)
        for _, tokens in _tokens(chunk):
            levels = shared.value.levels if shared is not None else lambda keys, x=looked_up: _in_order(x, 1)
            p = _probabilities(tokens, order, n, v, levels)
            doc = tokens.doc[tokens.token]
            c = counts[np.unique(tokens.hash[tokens.token], return_inverse=True)[1]]
            sums = lambda x, d=doc, m=len(tokens.ids): np.bincount(d, weights=x, minlength=m)
            base = np.log10((c + ADD) / (n + ADD * (v + 1)))
            out.append(pa.table({
                "id": pa.array(tokens.ids, pa.int64()),
                "trained": pa.array(tokens.train),
                "n_tokens": pa.array(tokens.n_tokens, pa.int64()),
                "n_known": pa.array(sums(c > 0).astype(np.int64)),
                "base_score": pa.array(sums(base)),
                "score": pa.array(sums(np.log10(p[tokens.token]))),
            }))
        return pa.concat_tables(out)

    return texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(one, SCORES), n
