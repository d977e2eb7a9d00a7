"""Shuffled shards by a two-pass external shuffle, DataFrame functions only.

Pass one deals every record to one of as many memory-sized buckets as the input
needs, by a seeded hash: Spark's shuffle files are the buckets, one per partition.
Pass two brings each bucket into a fixed order, shuffles it in memory (``shuffle``
is the Fisher-Yates shuffle, seeded by seed and bucket) and hands out consecutive
places; place modulo shard count is the shard.

The result depends on the rows and the seed alone, not on files, partitions or
attempts. Rows that are equal in all columns are numbered, and the number is part
of the hash, so copies of one row spread over the buckets like any others: they are
counted, combined before the shuffle, and made again from their number.

Laws: shard sizes in rows are at most one apart, and places are gapless. NULL
texts count as empty, NULL ids and texts are hashed as such, repeated rows are
kept, an empty table gives an empty result, other columns pass unchanged (maps
among them cannot be hashed and are refused).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardlake.llm.shared import Scratch

BUCKET_BYTES = 32 << 20
#: Bucket counts up to this many rows (16 bytes each) are broadcast.
BROADCAST_BUCKETS = 500_000
SUPER = 1024


#: Copies of one row that are made by one task.
COPIES = 4096


def _numbered(docs: DataFrame, seed: int) -> DataFrame:
    """``record`` (the whole row), its hashes ``h1``, ``h2``, and ``nth`` among equal rows."""
    # a hash passes over NULLs, so which columns are NULL is hashed too
    hashes = [F.xxhash64(F.lit(seed + k), *docs.columns, *[F.isnull(c) for c in docs.columns]).alias(f"h{k}") for k in (1, 2)]
    rows = docs.select(*hashes, F.struct("*").alias("record"))
    again = docs.select(*hashes).groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    again = Scratch(docs.sparkSession, "shards").write(again, "again")
    single = rows.withColumn("nth", F.lit(0).cast("long"))
    if again.isEmpty():
        return single
    copies = rows.join(again, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "record").agg(F.count("*").alias("n"))
    parts = copies.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    parts = parts.repartition("h1", "first")
    each = F.explode(F.sequence("first", F.least(F.col("first") + COPIES, "n") - 1))
    return single.join(again, ["h1", "h2"], "left_anti").unionByName(parts.select("h1", "h2", "record", each.alias("nth")))


def _bucket(seed: int, buckets: int):
    return F.pmod(F.xxhash64(F.lit(seed), "h1", "h2", "nth"), F.lit(buckets)).cast("int")


def _offsets(counts: DataFrame) -> DataFrame:
    """Places taken by the buckets before each one; running sums in two levels, so no window holds them all."""
    counts = counts.withColumn("upper", F.floor(F.col("bucket") / SUPER))
    inner = F.sum("n").over(W.partitionBy("upper").orderBy("bucket")) - F.col("n")
    # one row per 1024 buckets: a few thousand at 100 TB
    uppers = counts.groupBy("upper").agg(F.sum("n").alias("total"))
    base = uppers.select("upper", (F.sum("total").over(W.orderBy("upper")) - F.col("total")).alias("base"))
    return counts.withColumn("inner", inner).join(base, "upper").select("bucket", (F.col("base") + F.col("inner")).alias("offset"))


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 17, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``record`` (the whole row), ``shard`` and ``slot`` of every row.

    The input must be a stored table: it is read once for its size, once for
    equal rows, once for the bucket counts, and once to move the records.
    """
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(64))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    rows = _numbered(docs, seed).withColumn("bucket", _bucket(seed, buckets))
    offsets = _offsets(rows.groupBy("bucket").agg(F.count("*").alias("n")))
    item = F.struct(F.xxhash64(F.lit(seed + 3), "h1", "h2", "nth").alias("order"), "h1", "h2", "nth", "record")
    # bucket k is partition k, and the shuffle of a partition is seeded by its number
    dealt = rows.select("bucket", item.alias("item")).repartitionById(buckets, F.col("bucket"))
    place = lambda x: F.struct(x["order"], x["h1"], x["h2"], x["nth"])
    ordered = F.array_sort(F.collect_list("item"), lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0))
    shuffled = dealt.groupBy("bucket").agg(F.shuffle(ordered, seed).alias("items"))
    placed = shuffled.select("bucket", F.posexplode("items").alias("pos", "item"))
    placed = placed.join(F.broadcast(offsets) if buckets <= BROADCAST_BUCKETS else offsets, "bucket")
    at = F.col("offset") + F.col("pos")
    return placed.select("item.record", (at % shards).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """Records as ``path/shard=k``, in slot order; many files per shard, so a shard is never one task's work."""
    (
        sharded.repartitionByRange(files, "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .select("record.*", F.col("shard"), F.col("slot"))
        .write.partitionBy("shard")
        .parquet(path)
    )
