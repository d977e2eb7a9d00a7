"""Exact Jaccard links between documents' word n-gram sets, and their groups.

Sets are distinct 64-bit hashes of ``n`` consecutive lower-cased words. Equal
sets become one class first, whatever their number. Two sets with similarity t
share one of the first ``size - ceil(t * size) + 1`` members of each in any fixed
order; the order used puts hash buckets with many members last, so frequent
passages do not pair their documents.

Tiles are (member, size band) with bands as wide as t allows, each set in its
own tile and in the one below. First every class is held against the smallest
class of its tile only (a partial aggregation, no group in memory); links found
there are joined to components, and only tiles in which at least two components
meet are compared inside, in blocks of bounded size. Comparison is by hashed
bitmaps: a bit is the parity of the members hashed to it, so a bit that differs
is a member one side lacks, and counts of such bits bound the overlap from
above, closely even for bitmaps much smaller than the sets. A tile passes on
rows, never pairs: those that may link with a row of another component by their
signatures, and then, by the bitmaps, as many pairs as hold together what may
link. Groups of classes held together so are compared once more inside, again in
blocks, by intersecting the sorted arrays of pairs not yet in one component. No
link between different components is lost; nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.links import components
from wardlake.llm.shared import Scratch
from wardlake.llm.words import Words, binary_column, chunks, in_parts, keyed, list_column, mix, signed, texts_of

#: Buckets of the member frequency table: 2 MB, whatever the size of the corpus.
BUCKET_BITS, BLOCKS = 19, 64
#: Classes of one tile or group compared by one task with those of another block, and members of a group's block.
BLOCK_ROWS, BLOCK_MEMBERS = 1024, 1 << 20
_U = np.uint64


def _members(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct n-grams, sorted; shorter texts have one of all their words."""
    counts = np.diff(words.first)
    total = len(words.hash)
    text = np.repeat(np.arange(len(counts)), counts)
    if total >= n:
        starts = np.arange(total - n + 1)
        starts = starts[text[starts] == text[starts + n - 1]]
    else:
        starts = np.zeros(0, dtype=np.int64)
    hashes, owner = words.spans(starts, starts + n), text[starts]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        hashes = np.concatenate((hashes, words.spans(words.first[short], words.first[short + 1])))
        owner = np.concatenate((owner, short))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], hashes[new]


def _frequency(docs: DataFrame, key: str, text: str, n: int, scratch: Scratch) -> np.ndarray:
    """Members per hash bucket over the whole corpus, as 16 levels of frequency."""
    width = (1 << BUCKET_BITS) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        found = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for _, _, values, offsets in chunks(binary_column(batch, "text")):
                found += np.bincount((_members(Words(values, offsets, True), n)[1] >> _U(64 - BUCKET_BITS)).astype(np.int64), minlength=len(found))
        if found.any():
            parts = [found[b * width : (b + 1) * width].tobytes() for b in range(BLOCKS)]
            salt = (context.partitionId() if context else 0) // 256  # a group has 16 MB at most
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([salt] * BLOCKS, pa.int32()), pa.array(parts, pa.binary())], ["block", "salt", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype=np.int64)
        for c in group.column("counts").to_pylist():
            total += np.frombuffer(c, dtype=np.int64)
        return group.slice(0, 1).set_column(2, "counts", pa.array([total.tobytes()], pa.binary()))

    schema = "block int, salt int, counts binary"
    once = keyed(docs, key, text).mapInArrow(count, schema).groupBy("block", "salt").applyInArrow(add, schema)
    rows = once.groupBy("block").applyInArrow(add, schema).collect()  # BLOCKS rows, 4 MB
    found = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for r in rows:
        found[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["counts"], dtype=np.int64)
    # buckets near the mean are alike; only what stands out is put back
    mean = max(found.mean(), 1.0)
    return np.clip(np.log2(np.maximum(found, 1) / mean) * 4 + 4, 0, 60).astype(np.uint8)


#: Longs of the signature that tiles compare: 512 bits. Longs of the longest bitmap: 16 KB, so that a block of them fits.
SIGNATURE, LONGEST = 8, 2048


def _bitmap(hashes: np.ndarray) -> bytes:
    """Parity bits of the members: 512 at least, one for two members in large sets, up to the longest."""
    bits = min(max(64 * SIGNATURE, 1 << (len(hashes) // 2).bit_length()), 64 * LONGEST)
    counts = np.bincount((mix(hashes) & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _fold(bitmap: np.ndarray, longs: int) -> np.ndarray:
    """A longer bitmap as one of ``longs`` 64-bit words: bit k goes to bit k modulo its length."""
    while len(bitmap) > longs:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


SETS = "doc long, dh long, n long, f1 long, f2 long, prefix array<long>, bitmap binary, signature binary"


def _sets(docs: DataFrame, key: str, text: str, n: int, t: int, level: np.ndarray) -> DataFrame:
    """doc, dh, n, f1, f2 (128 bits of the set), prefix, bitmap and its 512-bit fold of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(level)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in batches:
            for lo, hi, values, offsets in chunks(binary_column(batch, "text")):
                w = Words(values, offsets, True)
                owner, h = _members(w, n)
                texts = hi - lo
                ends = np.searchsorted(owner, np.arange(texts + 1))
                sizes = np.diff(ends)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(mix(h) + _U(salt)))))
                    sums.append(mix((total[ends[1:]] - total[ends[:-1]]) + sizes.astype(np.uint64)))
                order = np.lexsort((h, levels[(h >> _U(64 - BUCKET_BITS)).astype(np.int64)], owner))
                rank = np.arange(len(h)) - ends[owner]
                limit = sizes - (-(-t * sizes // 100)) + 1
                take = rank < limit[owner]
                prefix = h[order][take]
                maps = [_bitmap(h[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                folds = [_fold(np.frombuffer(m, dtype=np.uint64), SIGNATURE).tobytes() for m in maps]
                counts = np.bincount(owner[take], minlength=texts)
                numbers = [pa.array(c) for c in (sizes.astype(np.int64), signed(sums[0]), signed(sums[1]))]
                made = [list_column(signed(prefix), counts), pa.array(maps, pa.binary()), pa.array(folds, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, texts), batch.column(1).slice(lo, texts), *numbers, *made], ["doc", "dh", "n", "f1", "f2", "prefix", "bitmap", "signature"])

    return keyed(docs, key, text).mapInArrow(work, SETS)


def _may_link(na: np.ndarray, nb: np.ndarray, apart: np.ndarray, t: int) -> np.ndarray:
    """Whether sets with at least ``apart`` members in only one of them can reach t percent."""
    return 100 * (na + nb - apart) >= t * (na + nb + apart)


def _rows_bound(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    """Pairs with both bitmaps: those the bound lets through."""
    for batch in batches:
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        apart = np.zeros(batch.num_rows, dtype=np.int64)
        for i, (x, y) in enumerate(zip(batch.column("ba").to_pylist(), batch.column("bb").to_pylist(), strict=True)):
            a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            size = min(len(a), len(b))
            apart[i] = np.bitwise_count(_fold(a, size) ^ _fold(b, size)).sum()
        yield batch.select(["a", "b"]).filter(pa.array(_may_link(na, nb, apart, t)))


def _bounded(pairs: DataFrame, classes: DataFrame, t: int) -> DataFrame:
    """Distinct pairs (a, b) whose sizes and bitmaps allow a link."""
    side = lambda s: classes.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("bitmap").alias(f"b{s}"))
    both = pairs.distinct().join(side("b"), "b").join(side("a"), "a")
    both = both.filter(f"100 * least(na, nb) >= {t} * greatest(na, nb)").select("a", "b", "na", "nb", "ba", "bb")
    return both.mapInArrow(lambda x: _rows_bound(x, t), "a long, b long")


def _arrays(wanted: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str, n: int, scratch: Scratch, name: str) -> DataFrame:
    """The sorted members of the classes wanted (cls), as bytes."""
    where = scratch.write(classes.select("cls", "doc", "dh").join(wanted, "cls"), f"{name}-wanted")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in in_parts(batch, lower=True):
                owner, h = _members(w, n)
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
                made = [h[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], ["doc", "dh", "members"])

    made = texts_of(docs, key, text, where, pack=False).mapInArrow(arrays, "doc long, dh long, members binary")
    return scratch.write(made.join(where, ["doc", "dh"]).select("cls", "members").dropDuplicates(["cls"]), f"{name}-arrays")


def _alike(x: bytes, y: bytes, t: int) -> bool:
    """Whether two sets, as sorted arrays, have a similarity of t percent."""
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= t * (len(a) + len(b) - common)


def _exact(pairs: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str, n: int, t: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs that are links, by intersecting the sorted arrays of the classes concerned."""
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = _arrays(wanted, docs, classes, key, text, n, scratch, name)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 128) for b in batches for at in range(0, b.num_rows, 128)):
            keep = [_alike(x, y, t) for x, y in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("cls").alias("b"), F.col("members").alias("mb")), "b")
    both = both.join(sets.select(F.col("cls").alias("a"), F.col("members").alias("ma")), "a").select("a", "b", "ma", "mb")
    return scratch.write(both.mapInArrow(meet, "a long, b long"), f"{name}-links")


#: A tile's pair of blocks, a group's pair of blocks, and what else their rows have.
TILE, GROUP = ["token", "tile", "first", "second"], ["cluster", "first", "second"]
ROW = ["x", "cls", "n", "root", "upper"]
TILE_ROWS = "token long, tile int, first int, second int, x int, cls long, n long, root long, upper boolean"


def _in_blocks(rows: DataFrame, blocks: DataFrame, *key: str) -> DataFrame:
    """Rows (cls) dealt to pairs of the ``blocks`` of their key: first, second, and x, their own."""
    rows = rows.join(blocks, list(key)).withColumn("x", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("first", F.least("x", "y")).withColumn("second", F.greatest("x", "y"))


def _tiles(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Tile rows dealt to pairs of blocks, (token, tile, first, second), with the class and its signature."""
    rows = members.select("token", "cls", "n", "root", F.explode(F.array(F.struct(F.col("band").alias("tile"), F.lit(False).alias("upper")), F.struct((F.col("band") - 1).alias("tile"), F.lit(True).alias("upper")))).alias("t"))
    rows = rows.select("token", "cls", "n", "root", "t.*")
    sizes = rows.groupBy("token", "tile").agg(F.count("*").alias("rows"), F.min("root").alias("r1"), F.max("root").alias("r2"), F.min("upper").alias("only_upper"))
    sizes = sizes.filter("r1 <> r2 and not only_upper").select("token", "tile", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"))
    return _in_blocks(rows, sizes, "token", "tile").join(classes.select("cls", F.col("signature").alias("bits")), "cls").select(*TILE, *ROW, "bits")


def _clusters(held: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Classes of each group that pairs of ``held`` join (node, root), dealt to pairs of blocks, with their bitmaps."""
    rows = held.select(F.col("node").alias("cls"), F.col("root").alias("cluster")).join(classes.select("cls", "n", F.col("bitmap").alias("bits")), "cls")
    rows = rows.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_MEMBERS)).cast("int")
    return _in_blocks(rows.withColumn("upper", F.lit(False)), rows.groupBy("cluster").agg(blocks.alias("blocks")), "cluster").select(*GROUP, *ROW, "bits")


def _apart(i: np.ndarray, j: np.ndarray, maps: list[np.ndarray], longs: np.ndarray) -> np.ndarray:
    """Bits in which the bitmaps of row pairs differ, folded to the shorter one's length."""
    out, size = np.zeros(len(i), dtype=np.int64), np.minimum(longs[i], longs[j])
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        rows, place = np.unique(np.concatenate((i[at], j[at])), return_inverse=True)
        folded = np.stack([_fold(maps[r], s) for r in rows])
        out[at] = np.bitwise_count(folded[place[: len(at)]] ^ folded[place[len(at) :]]).sum(axis=1)
    return out


def _close(table: pa.Table, key: list[str], t: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row pairs of one key that may link, and the bits they differ in: other component, size, bits."""
    c = {name: table.column(name).to_numpy() for name in (*key, *ROW)}
    maps = [np.frombuffer(b, dtype=np.uint64) for b in table.column("bits").to_pylist()]
    longs = np.array([len(m) for m in maps])
    alike = np.stack(maps) if len(np.unique(longs)) == 1 else None
    n, rows = c["n"], table.num_rows
    new = np.ones(rows, dtype=bool)
    new[1:] = np.any([c[k][1:] != c[k][:-1] for k in key], axis=0)
    group = np.cumsum(new) - 1
    left = np.bincount(group)[group] - (np.arange(rows) - np.flatnonzero(new)[group]) - 1  # rows of its key after this one
    step, all_i = 1, np.flatnonzero(left >= 1)
    while len(all_i):  # every row with the one `step` behind it
        i, j = all_i, all_i + step
        ok = (c["root"][i] != c["root"][j]) & ~(c["upper"][i] & c["upper"][j])
        # blocks meet only across; inside one block all rows meet
        ok &= (c["first"][i] == c["second"][i]) | (c["x"][i] != c["x"][j])
        i, j = i[ok], j[ok]
        ok = 100 * np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j])
        i, j = i[ok], j[ok]
        apart = _apart(i, j, maps, longs) if alike is None else np.bitwise_count(alike[i] ^ alike[j]).sum(axis=1).astype(np.int64)
        ok = _may_link(n[i], n[j], apart, t)
        yield i[ok], j[ok], apart[ok]
        step += 1
        all_i = all_i[left[all_i] >= step]


class _Joined:
    """Which of a few rows are joined so far; rows with one value are from the start."""

    def __init__(self, values: np.ndarray):
        self.node = np.unique(values, return_inverse=True)[1].tolist()
        self.up = list(range(len(self.node)))

    def top(self, row: int) -> int:
        at, up = self.node[row], self.up
        while up[at] != at:
            up[at] = up[up[at]]
            at = up[at]
        return at

    def join(self, i: int, j: int) -> None:
        self.up[self.top(i)] = self.top(j)


def _pairs(cls: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    i, j = (np.array(x, dtype=np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j]))], ["a", "b"])


def _near_rows(table: pa.Table, t: int) -> Iterator[pa.RecordBatch]:
    """The rows of tiles that may link with a row of another component."""
    near = np.zeros(table.num_rows, dtype=bool)
    for i, j, _ in _close(table, TILE, t):
        near[i] = near[j] = True
    yield from table.select([*TILE, *ROW]).filter(pa.array(near)).to_batches()


def _held(table: pa.Table, t: int) -> Iterator[pa.RecordBatch]:
    """Of the pairs that may link, as many as hold together all that they do: fewer than rows."""
    cls = table.column("cls").to_numpy()
    joined, found = _Joined(cls), []
    for ii, jj, _ in _close(table, TILE, t):
        for i, j in zip(ii.tolist(), jj.tolist(), strict=True):
            if joined.top(i) != joined.top(j):
                joined.join(i, j)
                found.append((i, j))
    yield _pairs(cls, found)


def _linked(table: pa.Table, t: int) -> Iterator[pa.RecordBatch]:
    """Links between components, the closest pairs first, until no other pair would join two: fewer than rows."""
    members = table.column("members").to_pylist()
    near = [np.concatenate(x) for x in zip(*_close(table, GROUP, t), strict=True)] or [np.zeros(0, np.int64)] * 3
    joined, found = _Joined(table.column("root").to_numpy()), []
    order = np.argsort(near[2], kind="stable")
    for i, j in zip(near[0][order].tolist(), near[1][order].tolist(), strict=True):
        if joined.top(i) != joined.top(j) and _alike(members[i], members[j], t):
            joined.join(i, j)
            found.append((i, j))
    yield _pairs(table.column("cls").to_numpy(), found)


def _whole(rows: DataFrame, key: list[str], work, t: int, schema: str) -> DataFrame:
    """``work`` on tables with all rows of each key in them; a pair of blocks has few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            same = np.logical_and.reduce([table.column(k).to_numpy() == table.column(k)[-1].as_py() for k in key])
            cut = int(np.flatnonzero(same)[0])
            if cut:
                yield from work(table.slice(0, cut), t)
            rest = table.slice(cut)
        if rest is not None:
            yield from work(rest, t)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, schema)


def link_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, every_row: bool = False) -> DataFrame:
    """doc, dh, n_shingles, component, kept of every distinct row; component is the smallest doc reachable by links.

    ``doc`` is the key with NULL as the smallest long. Rows without words have
    n_shingles 0 and are linked with nothing; for a NULL key their component is
    the smallest long too. ``kept`` holds for one row of each group. Rows with equal key and equal text are one;
    ``every_row`` returns their result once for each of them.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    sets = scratch.write(_sets(docs, key, text, n, percent, _frequency(docs, key, text, n, scratch)), "sets")
    filled = sets.filter("n > 0")
    same = filled.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc", "dh")).alias("first"))
    same = scratch.write(same.withColumn("cls", F.monotonically_increasing_id()), "same")
    first = same.select("cls", F.col("first.doc").alias("doc"), F.col("first.dh").alias("dh"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100)) + F.lit(1e-9)).cast("int")
    classes = filled.select("doc", "dh", "n", "prefix", "bitmap", "signature").join(first, ["doc", "dh"]).dropDuplicates(["cls"]).withColumn("band", band)
    classes = scratch.write(classes, "classes")
    members = classes.select("cls", "n", "band", F.explode("prefix").alias("token"))
    shared = members.groupBy("token").agg(F.count("*").alias("rows")).filter("rows > 1").select("token")
    members = scratch.write(members.join(shared, "token", "left_semi"), "members")
    # every class against the smallest of its tile
    tops = members.groupBy("token", "band").agg(F.min("cls").alias("a"), F.count("*").alias("rows")).filter("rows > 1")
    stars = members.join(tops.select("token", "band", "a"), ["token", "band"]).filter("cls > a").select("a", F.col("cls").alias("b"))
    stars = scratch.write(_bounded(stars, classes, percent), "stars")
    links = _exact(stars, docs, classes, key, text, n, percent, scratch, "star")
    roots = scratch.write(components(links, scratch, "star-parts"), "star-roots")
    # what is left are links between components
    known = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    near = scratch.write(_whole(_tiles(known, classes), TILE, _near_rows, percent, TILE_ROWS), "tile-rows")
    near = near.join(classes.select("cls", F.col("bitmap").alias("bits")), "cls")
    held = scratch.write(_whole(near, TILE, _held, percent, "a long, b long"), "tile-held")
    held = scratch.write(components(held, scratch, "held-parts"), "held")
    arrays = _arrays(held.select(F.col("node").alias("cls")), docs, classes, key, text, n, scratch, "held")
    more = scratch.write(_whole(_clusters(held, classes, roots).join(arrays, "cls"), GROUP, _linked, percent, "a long, b long"), "more")
    every = scratch.write(components(links.unionByName(more), scratch, "parts"), "roots")
    joined = same.select("cls", "f1", "f2", "n", "first").join(every.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    found = joined.join(least, "root").select("f1", "f2", "n", "least")
    rows = sets.select("doc", "dh", "n", "f1", "f2")
    rows = (rows if every_row else rows.distinct()).join(found, ["f1", "f2", "n"], "left")
    kept = F.col("least").isNull() | (F.struct("doc", "dh") == F.col("least"))
    return rows.select("doc", "dh", F.col("n").alias("n_shingles"), F.coalesce("least.doc", "doc").alias("component"), kept.alias("kept"))
