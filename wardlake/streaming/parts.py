"""Tables a stream keeps between micro-batches, changed by what arrives.

Every micro-batch writes its own rows as one part, a folder. After ``FAN`` parts
they are merged into one, after ``FAN`` of those again, and so on: a row is
written once per level, and a table of n micro-batches has at most ``FAN`` parts
per level, so neither the bytes written nor the files opened follow the history.

A table with keys holds the newest row of each key. Beside each part stands its
index: zones (lowest and highest last key per group of the other keys, newest time)
and a Bloom filter of its keys as bitmaps, so ``lookup`` opens only parts that hold one
of the wanted keys, but for few. Record numbers grow within a channel: new ones
are outside all zones, and no part with an index is opened at all. Small parts have
none and are read.

Parts of a micro-batch that is tried again are written anew; what it may need
from before is deleted one micro-batch later.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wardlake.session import delete, folders

#: Parts merged into one.
FAN = 8
#: Parts of fewer rows have no index: they are as quickly read.
INDEX_ROWS = 10_000
#: Bits of one bitmap (fixed by the bitmap functions), bits per key, bits set per key.
PAGE_BITS, KEY_BITS, PROBES = 32_768, 16, 4

Keep = Callable[[DataFrame, bool], DataFrame]


def _same(a: DataFrame, b: DataFrame, names: tuple[str, ...], prefix: str) -> Column:
    """Equality of columns that may be NULL; those of ``b`` bear a prefix."""
    same = F.lit(True)
    for c in names:
        same = same & a[c].eqNullSafe(b[prefix + c])
    return same


def without_keys(rows: DataFrame, gone: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows whose key, parts of which may be NULL, is not in ``gone``."""
    named = gone.select(*[F.col(c).alias(f"_g_{c}") for c in keys])
    return rows.join(named, _same(rows, named, keys, "_g_"), "left_anti")


def with_keys(rows: DataFrame, wanted: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows whose key, parts of which may be NULL, is in ``wanted``."""
    named = wanted.select(*[F.col(c).alias(f"_g_{c}") for c in keys])
    return rows.join(named, _same(rows, named, keys, "_g_"), "left_semi")


def newest(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The row with the highest ``order`` of each key; NULL is the lowest."""
    rest = [c for c in rows.columns if c not in keys]
    chosen = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("_r"))
    return chosen.select(*keys, "_r.*").select(*rows.columns)


class PartTable:
    """One such table of one writer; ``keys`` make it a table of newest rows."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: tuple[str, ...] = (), time: str | None = None, fan: int | None = None):
        self.spark, self.path, self.keys, self.time, self.fan = spark, path, keys, time, fan or FAN
        given = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        fields = [T.StructField(f.name, f.dataType) for f in given.fields]
        self.schema = T.StructType([*fields, T.StructField("changed", T.LongType())] if keys else fields)

    # --- parts ------------------------------------------------------------------

    def _all(self) -> list[tuple[int, int]]:
        names = [f.split("-") for f in folders(self.spark, f"{self.path}/rows") if "-" in f]
        return sorted((int(a), int(b)) for a, b in names)

    def parts(self, before: int | None = None) -> list[tuple[int, int]]:
        """(first, last) micro-batch of the parts that hold everything before one, oldest first."""
        out: list[tuple[int, int]] = []
        for a, b in sorted((p for p in self._all() if before is None or p[1] < before), key=lambda p: (p[0], -p[1])):
            if not out or b > out[-1][1]:
                out.append((a, b))
        return out

    def next_batch(self) -> int:
        """The number after the last part, for tables that are not written by a stream."""
        return max((b for _, b in self._all()), default=-1) + 1

    def _read(self, kind: str, parts: list[tuple[int, int]], schema: T.StructType) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{a}-{b}" for a, b in parts])

    def _delete(self, parts: list[tuple[int, int]]) -> None:
        for a, b in parts:
            for kind in ("rows", "index"):
                delete(self.spark, f"{self.path}/{kind}/{a}-{b}")

    # --- reading -----------------------------------------------------------------

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, of a table with keys the newest of each."""
        rows = self._read("rows", self.parts(before), self.schema)
        return newest(rows, self.keys, "changed") if self.keys else rows

    @property
    def _index_schema(self) -> T.StructType:
        """Rows of zones, and rows of filter pages (``_page`` is not NULL)."""
        kind = {f.name: f.dataType for f in self.schema.fields}
        zone = [T.StructField(c, kind[c]) for c in self.keys[:-1]]
        zone += [T.StructField(c, kind[self.keys[-1]]) for c in ("_low", "_high")]
        rest = {"_open": T.BooleanType(), "_newest": T.TimestampType(), "_timeless": T.BooleanType(), "_pages": T.LongType()}
        rest |= {"_part": T.StringType(), "_page": T.LongType(), "_bits": T.BinaryType()}
        return T.StructType([*zone, *(T.StructField(c, t) for c, t in rest.items())])

    def _index(self, parts: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
        rows = self._read("index", parts, self._index_schema)
        return rows.filter("_page IS NULL").drop("_page", "_bits"), rows.filter("_page IS NOT NULL").select("_part", "_page", "_bits")

    def _indexed(self, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        there = set(folders(self.spark, f"{self.path}/index"))
        return [p for p in parts if f"{p[0]}-{p[1]}" in there]

    def zones(self, before: int | None = None) -> DataFrame:
        """A few rows per part of a table with keys: which keys and times it spans."""
        parts = self.parts(before)
        indexed = self._indexed(parts)
        out = self._index(indexed)[0]
        for p in parts:
            if p not in indexed:
                small = self._zones_of(self._read("rows", [p], self.schema), 1).withColumn("_part", F.lit(f"{p[0]}-{p[1]}"))
                out = out.unionByName(small)
        return out

    def past(self, bound: datetime, before: int | None = None) -> list[str]:
        """Names of the parts without a row after ``bound``, as ``drop`` takes them; rows without a time are none."""
        parts, out = self.parts(before), self.spark.createDataFrame([], "_part string, _late boolean")
        for p in parts:
            late = F.coalesce(F.max(self.time) <= F.lit(bound), F.lit(True)).alias("_late")
            out = out.unionByName(self._read("rows", [p], self.schema).agg(F.lit(f"{p[0]}-{p[1]}").alias("_part"), late))
        return [r["_part"] for r in out.filter("_late").collect()]  # a few parts

    def lookup(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of the wanted keys. Starts a small job to learn which parts with an index to open."""
        parts = self.parts(before)
        indexed = self._indexed(parts)
        asked = wanted.select(*self.keys)
        open_ = self._met(asked, indexed) if indexed else set()
        open_ |= {f"{a}-{b}" for a, b in parts if (a, b) not in indexed}
        rows = self._read("rows", [p for p in parts if f"{p[0]}-{p[1]}" in open_], self.schema)
        return newest(with_keys(rows, asked, self.keys), self.keys, "changed")

    def _met(self, asked: DataFrame, parts: list[tuple[int, int]]) -> set[str]:
        """Names of the parts whose zones and filter do not rule out all keys."""
        group, last = self.keys[:-1], self.keys[-1]
        zones, pages = self._index(parts)
        zones = zones.withColumnsRenamed({c: f"_z_{c}" for c in group})
        inside = F.col("_open") | F.col(last).isNull() | F.col(last).between(F.col("_low"), F.col("_high"))
        near = asked.join(zones, _same(asked, zones, group, "_z_") & inside).select(*asked.columns, "_part", "_pages")
        near = near.withColumn("_page", self._page(F.col("_pages")))
        for i in range(PROBES):
            near = near.withColumn(f"_b{i}", self._bit(i))
        met = near.join(pages, ["_part", "_page"])
        for i in range(PROBES):
            byte = F.conv(F.hex(F.substring("_bits", F.expr(f"CAST(_b{i} DIV 8 + 1 AS INT)"), F.lit(1))), 16, 10).cast("long")
            met = met.filter(F.getbit(byte, (F.col(f"_b{i}") % 8).cast("int")) == 1)
        return {r["_part"] for r in met.select("_part").distinct().collect()}  # a few parts

    # --- writing -----------------------------------------------------------------

    def add(self, rows: DataFrame, batch_id: int, keep: Keep = lambda df, oldest: df) -> None:
        """Write the rows of a micro-batch (one per key) and merge what is due.

        ``keep`` says which rows of a merge stay; its second argument is true when
        no older part is left beside it, so that a row that only hides older ones
        may go.
        """
        self._delete([p for p in self._all() if p[1] >= batch_id])  # of an attempt that broke off
        if self.keys:
            rows = rows.withColumn("changed", F.lit(batch_id).cast("long"))
        self._write(rows, (batch_id, batch_id))
        width = self.fan
        while (batch_id + 1) % width == 0:
            first = batch_id + 1 - width
            inside = [p for p in self.parts() if p[0] >= first]
            if len(inside) < 2:
                break
            merged = self._read("rows", inside, self.schema)
            if self.keys:
                merged = newest(merged, self.keys, "changed")
            self._write(keep(merged, all(p[0] >= first for p in self.parts())), (first, batch_id))
            width *= self.fan
        held = set(self.parts(batch_id)) | set(self.parts())
        self._delete([p for p in self._all() if p not in held and p[1] < batch_id and any(a <= p[0] and p[1] <= b < batch_id for a, b in held)])

    def drop(self, names: list[str]) -> None:
        """Delete parts (as zones name them) that nothing can ask for any more."""
        self._delete([(int(a), int(b)) for a, b in (n.split("-") for n in names)])

    def _write(self, rows: DataFrame, part: tuple[int, int]) -> None:
        name = f"{part[0]}-{part[1]}"
        rows = rows.select(*self.schema.fieldNames())
        if self.keys:
            rows = rows.sortWithinPartitions(*self.keys)
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/{name}")
        stored = self._read("rows", [part], self.schema)
        n = stored.count()  # from the footers
        if not n:  # a part without rows is none
            self._delete([part])
        elif self.keys and n >= INDEX_ROWS:
            pages = -(-n * KEY_BITS // PAGE_BITS)
            index = self._zones_of(stored, pages).unionByName(self._filter_of(stored, pages), allowMissingColumns=True)
            index = index.withColumn("_part", F.lit(name)).select(*self._index_schema.fieldNames())
            index.coalesce(-(-pages // 10_000)).write.mode("overwrite").parquet(f"{self.path}/index/{name}")

    def _zones_of(self, rows: DataFrame, pages: int) -> DataFrame:
        time, last = F.col(self.time) if self.time else F.lit(None).cast("timestamp"), self.keys[-1]
        return rows.groupBy(*self.keys[:-1]).agg(
            F.min(last).alias("_low"), F.max(last).alias("_high"), F.bool_or(F.col(last).isNull()).alias("_open"),
            F.max(time).alias("_newest"), F.bool_or(time.isNull()).alias("_timeless"), F.lit(pages).cast("long").alias("_pages"),
        )

    def _page(self, pages: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), *self.keys), pages)

    def _bit(self, i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(i), *self.keys), F.lit(PAGE_BITS).cast("long"))

    def _filter_of(self, rows: DataFrame, pages: int) -> DataFrame:
        bits = F.explode(F.array(*[self._bit(i) for i in range(PROBES)]))
        each = rows.select(self._page(F.lit(pages).cast("long")).alias("_page"), bits.alias("_b"))
        return each.groupBy("_page").agg(F.bitmap_construct_agg("_b").alias("_bits"))
