"""Nearest neighbours by shifted space-filling curves.

Inner-product search becomes angular search by one more coordinate that gives
all vectors the same length. Every curve projects the vectors onto a few random
orthogonal directions, shifts them by a random amount and sorts them along a
Hilbert curve; curve positions are cut into blocks of about equal numbers of
vectors at approximate quantiles. A query looks at its own block and the
neighbouring ones of every curve; each block gives its best candidates by exact
double-precision products, and the candidates of all curves are merged.

Equal vectors are one class: the search runs over classes, and the smallest ids
of a class stand in for it, as many as a result can hold. So a vector that
occurs very often costs one row. Curve keys end in a hash, so equal positions
are spread over blocks.

Vectors that are NULL, zero, hold NULL or non-finite components, or have another
length than most, take no part; a NULL id takes no part. Ids are taken once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardlake.llm.shared import Scratch

#: Curves, projected dimensions, bits of each, and the share of a curve a query looks at.
CURVES, DIMS, BITS, SHARE = 16, 8, 6, 0.125
#: Vectors in a block at most, about; blocks per curve at least where the table allows.
BLOCK_ROWS, MIN_BLOCKS = 4096, 24
SEED = 5


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cell numbers along the Hilbert curve (dims * bits at most 62)."""
    x = cells.T.astype(np.uint64).copy()
    dims, one = x.shape[0], np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:  # undo the rotations and reflections of each level, coarse to fine
        low = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], dtype=np.uint64), np.uint64(1 << (bits - 1))
    while q > one:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - one), turn)
        q >>= one
    x ^= turn
    place = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << one) | ((x[i] >> np.uint64(b)) & one)
    return place


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(good).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def _keys(classes: DataFrame, width: int, longest: float, curves: int, extra: str) -> DataFrame:
    """(curve, place) of every class on every curve, beside its number, vector and whether it is asked for."""
    dims = min(DIMS, width + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.PCG64(SEED))
        turns = [np.linalg.qr(rng.normal(size=(width + 1, width + 1)))[0][:, :dims] for _ in range(curves)]
        shifts = [rng.uniform(0, 2, dims) for _ in range(curves)]
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("v")), width)
            x = np.hstack((x, np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))[:, None])) / longest
            for c in range(curves):
                # four standard deviations of a random unit vector's coordinate on each side
                y = (x @ turns[c]) * math.sqrt(width + 1) / 8 + 0.5
                cells = np.clip(y * ((1 << BITS) - 2) + shifts[c], 0, (1 << BITS) - 1)
                place = hilbert(cells, BITS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(place), *batch.columns], ["curve", "place", *batch.schema.names])

    schema = "curve int, place long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    keyed = classes.mapInArrow(work, schema)
    return keyed.withColumn("place", F.shiftleft("place", 12).bitwiseOR(F.pmod(F.xxhash64(extra), F.lit(4096))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _search(table: pa.Table, width: int, k: int) -> pa.Table:
    """The k best classes of one block for every query that looks at it."""
    asks = np.asarray(table.column("ask"))
    cls = np.asarray(table.column("cls"))
    x = np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(-1, width)
    queries, rows = np.flatnonzero(asks), np.flatnonzero(~asks)
    query, found, score = [], [], []
    best = min(k, len(rows))
    for at in range(0, len(queries) if best else 0, 512):
        some = queries[at : at + 512]
        products = x[some] @ x[rows].T
        top = np.argpartition(-products, best - 1, axis=1)[:, :best]
        query.append(np.repeat(cls[some], best))
        found.append(cls[rows][top].ravel())
        score.append(np.take_along_axis(products, top, axis=1).ravel())
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return pa.table({"query": join(query, np.int64), "cls": join(found, np.int64), "score": join(score, np.float64)})


def nearest(vectors: DataFrame, asked: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", curves: int = CURVES, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest other rows found for every row with ``asked``.

    ``asked`` is a condition on the id, given over the column ``id``.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "curves")
    rows = _usable(vectors, key, vector).groupBy("id").agg(F.max("v").alias("v"))
    rows = scratch.write(rows, "rows")
    sizes = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    width = sizes["w"]
    rows = rows.filter(F.size("v") == width)
    # of a class that occurs often, k + 1 ids are enough for any result; the limit is applied before the shuffle
    few = rows.withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("nth") <= k + 1)
    members = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asks = rows.filter(asked).select("id", "v")
    classes = members.join(asks.select("v").distinct().withColumn("ask", F.lit(True)), "v", "left")
    classes = classes.select(F.monotonically_increasing_id().alias("cls"), "v", "ids", F.coalesce("ask", F.lit(False)).alias("ask"))
    classes = scratch.write(classes, "classes")
    total, longest = classes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    longest = math.sqrt(longest) * (1 + 1e-12)
    # a block holds twice a result at least, so small tables are searched whole
    blocks = max(1, min(max(MIN_BLOCKS, math.ceil(total / BLOCK_ROWS)), total // (2 * (k + 1))))
    reach = max(1, round((share * blocks - 1) / 2))
    keys = scratch.write(_keys(classes.select("cls", "v", "ask"), width, longest, curves, "cls"), "keys")
    steps = [i / blocks for i in range(1, blocks)]
    cuts = keys.groupBy("curve").agg(F.percentile_approx("place", steps or [0.5], 100 * blocks).alias("e"))
    edges = {r["curve"]: r["e"] if steps else [] for r in cuts.collect()}
    placed = _blocks(keys, {c: np.sort(np.array(e, dtype=np.int64)) for c, e in edges.items()})
    base = placed.select("curve", "block", "cls", "v", F.lit(False).alias("ask"))
    near = F.explode(F.sequence(F.greatest(F.lit(0), F.col("block") - reach), F.least(F.lit(blocks - 1), F.col("block") + reach)))
    looks = placed.filter("ask").select("curve", near.alias("block"), "cls", "v", F.lit(True).alias("ask"))
    found = base.unionByName(looks).groupBy("curve", "block").applyInArrow(lambda t: _search(t, width, k + 1), "query long, cls long, score double")
    found = found.groupBy("query", "cls").agg(F.max("score").alias("score"))
    best = found.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "cls"))).filter(F.col("nth") <= 2 * k + 1)
    best = scratch.write(best.select("query", "cls", "score"), "found")
    members = best.join(classes.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    queries = asks.join(classes.select("v", F.col("cls").alias("query")), "v").select("query", F.col("id").alias("query_id"))
    pairs = queries.join(members, "query").filter("query_id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(keys: DataFrame, edges: dict[int, np.ndarray]) -> DataFrame:
    """The keys with the number of edges below their place; a curve has an edge for about BLOCK_ROWS vectors."""
    sent = keys.sparkSession.sparkContext.broadcast(edges)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            curve, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            block = np.zeros(len(curve), dtype=np.int32)
            for c in np.unique(curve):
                block[curve == c] = np.searchsorted(sent.value[c], place[curve == c], side="left")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], [*batch.schema.names, "block"])

    return keys.mapInArrow(work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema) + ", block int")
