"""Connected components of link tables: stars of bounded chunks, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.shared import Scratch

#: Links that a task holds at once (4 MB of node numbers).
CHUNK = 1 << 18


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Every node of the links but the smallest of its component here (u), with that one (v)."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    up, i, j = np.arange(len(nodes)), place[: len(a)], place[len(a) :]
    while len(i):
        np.minimum.at(up, np.maximum(i, j), np.minimum(i, j))
        while not np.array_equal(up, further := up[up]):
            up = further
        i, j = up[i], up[j]
        apart = i != j
        i, j = i[apart], j[apart]
    low = up != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[low]), pa.array(nodes[up[low]])], ["u", "v"])


def _joined(links: DataFrame, rows: int) -> DataFrame:
    """Links (u, v) as stars of chunks that one task reads; tasks grow with the ``rows``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            n += batch.num_rows
            if n >= 2 * CHUNK:
                stars = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [(stars.column("u").to_numpy(), stars.column("v").to_numpy())], stars.num_rows
                if n >= CHUNK:
                    yield stars
                    held, n = [], 0
        if n:
            yield _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return links.coalesce(max(1, -(-rows // CHUNK))).mapInArrow(work, "u long, v long")


def _shortened(edges: DataFrame) -> DataFrame:
    """A large star and a small star of links (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(low, "u")
    small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return small.distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root of every node that has a link (a, b long); root is the smallest node reachable.

    ``links`` must be a stored table. A task joins the links that it reads, a
    bounded number of them at once, which leaves fewer of them than nodes; a
    table of one such chunk is done then. Else stars, an aggregation and a join
    on narrow rows, link the chunks, and what comes out is joined by chunks
    again; a node with very many links is a skewed join key, not a group held in
    memory. No step gives a node a larger neighbour as its smallest, so a step
    without a change leaves stars only.
    """
    links = links.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    rows, state, step = links.count(), None, 0
    while True:
        edges = scratch.write(_joined(links, rows), f"{name}-{step}")
        if step:
            scratch.drop(f"{name}-{step - 1}")
        if rows <= CHUNK:
            break
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        rows, state, step = now[0], now, step + 1
        links = _shortened(edges) if rows > CHUNK else edges
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
