"""Bulk-synchronous best-fit packing of items into sequences of fixed capacity.

Items wait in bands of halving size, largest first. A round sorts the waiting
items of a band and the open gaps by size over all tasks (range partitioning)
and sweeps from large to small: an item takes the nearest gap above it that is
still free. Inside a slice that is a matching of parentheses; what a slice
leaves over (items without a gap, then gaps without an item) is matched between
slices from two counts per slice, and the k-th loser of a run meets its k-th gap
by rank. Gaps are updated and the round repeats. When a round places little, as
many of the largest waiting items as their total needs open sequences of their
own.

Wide gaps offer several slots per round when the band is small against them, so
rounds depend on the number of bands, not on items per sequence.

Nothing is held whole: a slice is one range partition, the driver sees two
counts per slice and one size histogram of at most ``capacity`` rows, and every
round's tables are written to the shared folder. Equal sizes are spread over
slices by the item number. Items must have distinct numbers, sizes from 1 to
``capacity``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardlake.llm.shared import Scratch

BANDS = 4
#: Rows of one slice of a sweep, about; items of one size whose hashes are looked at one by one.
SLICE_ROWS, FEW = 50_000, 5000
#: A round that places a smaller share of its items is followed by new sequences.
LITTLE = 0.6
SWEPT = "pair boolean, gap boolean, slice int, place long, item long, size int, seq long, slot int"


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one sorted slice, and what it leaves over, numbered in order."""
    read = list(batches)
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    if not read:
        return
    table = pa.Table.from_batches(read)
    gap, item, value, slot = (table.column(c).to_numpy() for c in ("gap", "id", "value", "slot"))
    step = np.where(gap, 1, -1)
    height = np.cumsum(step)
    low = np.minimum(np.minimum.accumulate(height), 0)
    alone = ~gap & (low < np.concatenate(([0], low[:-1])))
    level = height - low + np.where(gap, 0, 1)
    rows = np.flatnonzero(~alone)
    rows = rows[np.lexsort((rows, level[rows]))]
    same = np.zeros(len(rows), dtype=bool)
    if len(rows) > 1:
        same[:-1] = gap[rows[:-1]] & ~gap[rows[1:]] & (level[rows[:-1]] == level[rows[1:]])
    gaps, items = rows[same], rows[np.flatnonzero(same) + 1]
    free = gap.copy()
    free[gaps] = False
    lost, left = np.flatnonzero(alone), np.flatnonzero(free)

    def part_of(pair: bool, is_gap: bool, place, ids, size, seq, slots) -> pa.RecordBatch:
        n = len(place)
        columns = [np.full(n, pair), np.full(n, is_gap), np.full(n, part, np.int32), place.astype(np.int64), ids, size.astype(np.int32), seq, slots.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pair", "gap", "slice", "place", "item", "size", "seq", "slot"])

    yield part_of(True, False, np.arange(len(items)), item[items], value[items], item[gaps], slot[gaps])
    yield part_of(False, False, np.arange(len(lost)), item[lost], value[lost], np.zeros(len(lost), np.int64), np.zeros(len(lost)))
    yield part_of(False, True, np.arange(len(left))[::-1], np.zeros(len(left), np.int64), value[left], item[left], slot[left])


def _segments(counts: dict[int, tuple[int, int]]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Runs (slice, from, to, first match number) of lost items and of free gaps that meet, over the slices in order."""
    items, gaps, stack, number = [], [], [], 0
    for part in sorted(counts):
        lost, free = counts[part]
        at = 0
        while at < lost and stack:
            other, used, n = stack[-1]
            k = min(lost - at, n - used)
            items.append((part, at, at + k, number))
            gaps.append((other, used, used + k, number))
            number += k
            at += k
            stack[-1] = (other, used + k, n)
            if used + k == n:
                stack.pop()
        if free:
            stack.append((part, 0, free))
    return items, gaps


def _numbered(rows: DataFrame, runs: list[tuple[int, int, int, int]]) -> DataFrame:
    """``rows`` (slice, place, ...) with their match number, -1 without one; the runs are at most two per slice."""
    runs = sorted(runs)
    table = np.array(runs, dtype=np.int64).reshape(-1, 4)
    lo = table[:, 0] << 40 | table[:, 1]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, place = b.column("slice").to_numpy().astype(np.int64), b.column("place").to_numpy()
            k = np.searchsorted(lo, part << 40 | place, side="right") - 1
            ok = k >= 0
            k = np.maximum(k, 0)
            m = np.full(len(part), -1, dtype=np.int64)
            if len(table):
                ok &= (table[k, 0] == part) & (place >= table[k, 1]) & (place < table[k, 2])
                m[ok] = (table[k, 3] + place - table[k, 1])[ok]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m)], [*b.schema.names, "match"])

    return rows.mapInArrow(number, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", match long")


def _sweep(scratch: Scratch, number: int, waiting: DataFrame, gaps: DataFrame, lo: int, hi: int, rows: int) -> tuple[DataFrame, DataFrame, int]:
    """One round: (item, size, seq, slot) placed, (item, size) still waiting, and how many wait."""
    many = F.greatest(F.lit(1), F.floor(F.col("cap") / hi)).cast("int")
    slots = gaps.filter(F.col("cap") > lo).withColumn("many", many)
    slots = slots.select(F.lit(True).alias("gap"), F.col("seq").alias("id"), F.floor(F.col("cap") / F.col("many")).cast("int").alias("value"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("slot"))
    items = waiting.select(F.lit(False).alias("gap"), F.col("item").alias("id"), F.col("size").alias("value"), F.lit(0).alias("slot"))
    order = [F.desc("value"), F.desc("gap"), F.asc("id"), F.asc("slot")]
    parts = max(1, min(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SLICE_ROWS)))
    swept = slots.unionByName(items).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_match, SWEPT)
    swept = scratch.write(swept, f"{number}-swept")
    counts: dict[int, tuple[int, int]] = {}
    for r in swept.filter("not pair").groupBy("slice").agg(F.count_if(~F.col("gap")).alias("lost"), F.count_if("gap").alias("free")).collect():
        counts[r["slice"]] = (r["lost"], r["free"])
    runs = _segments(counts)
    left = sum(lost for lost, _ in counts.values()) - sum(to - at for _, at, to, _ in runs[0])
    pairs = swept.filter("pair").select("item", "size", "seq", "slot")
    lost = swept.filter("not pair and not gap").select("slice", "place", "item", "size")
    if runs[0]:
        lost = _numbered(lost, runs[0])
        free = _numbered(swept.filter("not pair and gap").select("slice", "place", "seq", "slot"), runs[1]).filter("match >= 0")
        across = lost.filter("match >= 0").select("match", "item", "size").join(free.select("match", "seq", "slot"), "match")
        pairs = pairs.unionByName(scratch.write(across.select("item", "size", "seq", "slot"), f"{number}-across"))
        lost = lost.filter("match < 0")
    return pairs, lost.select("item", "size"), left


def _openers(waiting: DataFrame, capacity: int, room: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """The largest waiting items, as many as sequences ``room`` (or their total) needs; the others; how many others.

    Of the smallest size taken, those with the smallest hash are taken: exactly
    where the size has few items, else about a share of them.
    """
    order = F.xxhash64(F.lit(31), "item")
    sizes = sorted(((r["size"], r["n"]) for r in waiting.groupBy("size").agg(F.count("*").alias("n")).collect()), reverse=True)
    need, taken, least, bound = -(-(room or sum(s * n for s, n in sizes)) // capacity), 0, 0, None
    for least, n in sizes:
        if n >= need:
            if n <= FEW:
                bound = sorted(r[0] for r in waiting.filter(F.col("size") == least).select(order).collect())[need - 1]
                taken += need
            else:
                bound = int(-(2**63) + (2**64 - 1) * need / n)
                taken += max(1, need)
            break
        taken += n
        need -= n
    new = (F.col("size") > least) | (F.col("size") == least) & (order <= F.lit(min(bound, 2**63 - 1)))
    return waiting.filter(new), waiting.filter(~new), sum(n for _, n in sizes) - taken


def _lacking(waiting: DataFrame, gaps: DataFrame, lo: int, n: int, left: int) -> int:
    """Room for which sequences are to be opened now: 0 while gaps are still found, else what waits.

    In the last band items fit nearly anywhere; there the room in all gaps counts,
    not how many items found a slot in one round.
    """
    if n > left and lo and n - left >= LITTLE * n:
        return 0
    total = waiting.agg(F.sum("size")).first()[0] or 0
    if n == left or lo:
        return total
    return max(0, total - (gaps.agg(F.sum("cap")).first()[0] or 0))


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """item, seq, offset of every row of ``items`` (item long, size int); ``seq`` is the number of the item that opened it.

    ``items`` must be a stored table: it is read again for every band.
    """
    scratch = Scratch(items.sparkSession, "packing")
    items = items.select("item", F.col("size").cast("int").alias("size"))
    half = capacity // 2
    opened = items.filter(F.col("size") > half).select("item", "size", F.col("item").alias("seq"), F.lit(0).alias("slot"))
    placed = [opened.withColumn("round", F.lit(0))]
    gaps = opened.filter(F.col("size") < capacity).select("seq", (F.lit(capacity) - F.col("size")).alias("cap"))
    bounds = [half >> k for k in range(BANDS)] + [0]
    sizes = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}
    number, open_gaps = 0, sum(n for s, n in sizes.items() if s > half)
    for hi, lo in zip(bounds, bounds[1:], strict=False):
        n = sum(k for s, k in sizes.items() if lo < s <= hi)
        waiting = items.filter((F.col("size") > lo) & (F.col("size") <= hi))
        while n > 0:
            number += 1
            pairs, waiting, left = _sweep(scratch, number, waiting, gaps, lo, hi, n + open_gaps)
            placed.append(pairs.withColumn("round", F.lit(number)))
            used = pairs.groupBy("seq").agg(F.sum("size").cast("int").alias("used"))
            gaps = gaps.join(used, "seq", "left").select("seq", (F.col("cap") - F.coalesce("used", F.lit(0))).alias("cap"))
            room = _lacking(waiting, gaps, lo, n, left) if left else 0
            if room:
                start, waiting, rest = _openers(waiting, capacity, room)
                open_gaps += left - rest
                left = rest
                start = start.select("item", "size", F.col("item").alias("seq"), F.lit(0).alias("slot"))
                placed.append(start.withColumn("round", F.lit(0)))
                gaps = gaps.unionByName(start.select("seq", (F.lit(capacity) - F.col("size")).alias("cap")))
            gaps = scratch.write(gaps.filter("cap > 0"), f"{number}-gaps")
            n = left
    rows = placed[0]
    for x in placed[1:]:
        rows = rows.unionByName(x)
    inside = W.partitionBy("seq").orderBy("round", "slot", "item")
    return rows.select("item", "seq", (F.sum("size").over(inside) - F.col("size")).cast("long").alias("offset"))
