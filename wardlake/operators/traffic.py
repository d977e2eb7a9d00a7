"""Packet statistics: counters, top talkers, recent packets, reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardlake.functions.ip import ipv4_number
from wardlake.operators.sizes import BROADCAST_ROWS
from wardlake.session import cut_lineage

# Length of top lists and of the recent list.
TOP = 10
RECENT = 10

DIMENSIONS = ("source_ip", "dest_ip", "port", "protocol")


def traffic_counts(packets: DataFrame) -> DataFrame:
    """Packets per source, destination, port and protocol in one pass.

    Absent, empty and zero values are not counted. ``first_seen`` is the lowest
    sequence number. Counts are combined before the shuffle, so a talker with a
    third of all packets costs one row per input task.
    """
    named = packets.select("seq", *[F.col(d).cast("string").alias(d) for d in DIMENSIONS])
    sets = named.groupingSets([[d] for d in DIMENSIONS], *DIMENSIONS).agg(
        F.count(F.lit(1)).alias("packets"),
        F.min("seq").alias("first_seen"),
        F.grouping_id().alias("_set"),
    )
    # The grouping id has a zero bit for the one column a row is grouped by.
    bits = len(DIMENSIONS)
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, name in enumerate(DIMENSIONS):
        mine = F.col("_set") == (2**bits - 1) - 2 ** (bits - 1 - i)
        dimension = F.when(mine, name).otherwise(dimension)
        value = F.when(mine, F.col(name)).otherwise(value)
    zero = F.col("dimension").isin("port", "protocol") & (F.col("value") == "0")
    return sets.select(
        dimension.alias("dimension"), value.alias("value"), "packets", "first_seen"
    ).filter((F.col("value") != "") & ~zero)


def total_packets(packets: DataFrame) -> DataFrame:
    return packets.agg(F.count(F.lit(1)).alias("total_packets"))


def top_talkers(counts: DataFrame, n: int = TOP) -> DataFrame:
    """The ``n`` largest values per dimension; equal counts go by who was seen first."""
    order = Window.partitionBy("dimension").orderBy(
        F.desc("packets"), F.asc("first_seen"), F.asc("value")
    )
    return (
        counts.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= n)
        .select("dimension", "place", "value", "packets")
    )


def top_ip_union(top: DataFrame) -> DataFrame:
    """Distinct addresses of the two top lists."""
    return (
        top.filter(F.col("dimension") == "source_ip")
        .select(F.col("value").alias("ip"))
        .union(top.filter(F.col("dimension") == "dest_ip").select(F.col("value").alias("ip")))
        .distinct()
    )


def active_ips(counts: DataFrame, n: int = TOP) -> DataFrame:
    """Addresses in the two top lists, and the true number of addresses beside it."""
    ips = counts.filter(F.col("dimension").isin("source_ip", "dest_ip"))
    listed = top_talkers(ips, n)
    per_ip = ips.select("value", F.lit(False).alias("in_top")).union(
        listed.select("value", F.lit(True))
    )
    return (
        per_ip.groupBy("value")
        .agg(F.max("in_top").alias("in_top"))
        .agg(
            F.count_if("in_top").alias("active_ips"),
            F.count(F.lit(1)).alias("active_ips_exact"),
        )
    )


def capture_span(packets: DataFrame) -> DataFrame:
    """Seconds between the first and the last packet."""
    seconds = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1_000_000)
    return packets.agg(seconds.cast("double").alias("uptime_seconds"))


def recent_packets(packets: DataFrame, n: int = RECENT) -> DataFrame:
    """The last ``n`` packets in arrival order."""
    keys = [c for c in ("ts", "seq", "source_ip", "dest_ip", "port", "length") if c in packets.columns]
    last = packets.orderBy(*[F.desc(c) for c in keys]).limit(n)
    return last.orderBy(*keys)


def packet_view(packets: DataFrame) -> DataFrame:
    """Packets as shown in the list: text for everything, placeholders for what is absent."""
    shown = lambda c, text: F.when(F.col(c) != "", F.col(c)).otherwise(text)
    return packets.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("time"),
        shown("source_ip", "N/A").alias("source_ip"),
        shown("dest_ip", "N/A").alias("dest_ip"),
        F.when((F.col("protocol") != "") & (F.col("protocol") != "0"), F.col("protocol"))
        .otherwise("Unknown")
        .alias("protocol"),
        F.when(F.col("port") != 0, F.col("port").cast("string")).otherwise("N/A").alias("port"),
        "length",
    )


def split_feed(feed: DataFrame) -> DataFrame:
    """Feed rows as address ranges: ``bits`` leading bits equal to ``net``."""
    parts = F.split("ip", "/")
    bits = F.when(F.size(parts) == 2, parts[1].try_cast("int")).otherwise(32)
    address = ipv4_number(parts[0])
    return (
        feed.withColumn("bits", bits)
        .withColumn("net", _leading(address, F.col("bits")))
        .filter(F.col("net").isNotNull() & F.col("bits").between(0, 32))
    )


def _leading(number: Column, bits: Column) -> Column:
    return F.call_function("shiftright", number, F.lit(32) - bits)


def _ends(packets: DataFrame) -> DataFrame:
    """One row per packet and direction."""
    each = F.array(
        F.struct(F.lit("source").alias("direction"), F.col("source_ip").alias("ip")),
        F.struct(F.lit("destination").alias("direction"), F.col("dest_ip").alias("ip")),
    )
    return packets.select("seq", "ts", F.explode(each).alias("_e")).select("seq", "ts", "_e.*")


ENTRY = ("category", "confidence")
FOUND = ("seq", "ts", "direction", "ip", "feed_entry", *ENTRY)


def reputation(packets: DataFrame, feed: DataFrame) -> DataFrame:
    """Packets from or to addresses of the feed, one row per packet, direction and feed row.

    Single addresses are compared as they are. A feed row may also be a range
    ``a.b.c.d/len``: the lengths that occur (at most 32) are tried on the packet
    rows themselves. A feed of checked size is broadcast and no packet moves;
    for a larger one see ``range_reputation``.
    """
    listed = split_feed(feed)
    # One row per length: how many feed rows have it.
    sizes = {r["bits"]: r["count"] for r in listed.groupBy("bits").count().collect()}
    if sum(sizes.values()) > BROADCAST_ROWS:
        return range_reputation(packets, feed)
    entry = (F.col("ip").alias("feed_entry"), *ENTRY)
    ends = _ends(packets)
    single = listed.filter(F.col("bits") == 32).select(F.split("ip", "/")[0].alias("key"), *entry)
    found = ends.join(F.broadcast(single), F.col("ip") == F.col("key")).drop("key")
    lengths = sorted(set(sizes) - {32})
    if lengths:
        ranges = F.broadcast(listed.filter(F.col("bits") < 32).select("bits", "net", *entry))
        found = found.unionByName(_by_length(ends.withColumn("_n", ipv4_number(F.col("ip"))), ranges, lengths))
    return found.select(*FOUND)


def _by_length(ends: DataFrame, ranges: DataFrame, lengths: list[int]) -> DataFrame:
    """Equality of (length, leading bits), each length tried on each row."""
    tried = ends.withColumn("bits", F.explode(F.array(*[F.lit(b) for b in lengths])))
    tried = tried.withColumn("net", _leading(F.col("_n"), F.col("bits")))
    return tried.join(ranges, ["bits", "net"]).drop("bits", "net", "_n")


#: Ranges of at least so many bits lie in one block of 256 addresses; blocks are marked by
#: their leading 24 bits, those of wider ranges by 16.
NEAR_BITS, FAR_BITS = 24, 16


def block_marks(blocks: DataFrame) -> DataFrame:
    """Numbers (``block``) as bitmaps of 32,768 of them: at most 512 rows and 2 MB for 24-bit numbers, whatever the feed."""
    place = F.bitmap_bit_position(F.col("block") + 1)
    return blocks.groupBy(F.bitmap_bucket_number(F.col("block") + 1).alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_marks"))


def _marked(ends: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """The rows whose block is marked, with its number; decided where the rows are."""
    rows = ends.withColumn("block", _leading(F.col("_n"), F.lit(bits)))
    rows = rows.withColumn("_bucket", F.bitmap_bucket_number(F.col("block") + 1)).withColumn("_place", F.bitmap_bit_position(F.col("block") + 1))
    met = rows.join(F.broadcast(marks), "_bucket")
    byte = F.conv(F.hex(F.substring("_marks", F.expr("CAST(_place DIV 8 + 1 AS INT)"), F.lit(1))), 16, 10).cast("long")
    return met.filter(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1).drop("_bucket", "_place", "_marks")


def range_reputation(packets: DataFrame, feed: DataFrame, counted: bool = False) -> DataFrame:
    """The same for a feed of any size.

    The blocks of addresses that any feed row touches are marked in bitmaps, which
    have at most 2 MB and are broadcast. They rule out packets where they lie; only
    those left, narrow, meet the feed. A range of 24 bits or more lies in one block
    and is compared with the addresses of that block, of which it cuts out an
    interval; feed rows of one block are few, at most 511 ranges, and a block with
    very many packets is a skewed join key that adaptive execution splits. Wider ranges are
    found by length and leading bits.

    With ``counted`` the packets of an address are counted before it meets the feed: one row
    per direction, address and feed row, with their number in ``packets``. Nested ranges then
    multiply addresses, not packets.
    """
    # written before it is parsed: the tests of addresses would move into the making of the feed
    listed = cut_lineage(split_feed(cut_lineage(feed)).withColumn("bits", F.col("bits").cast("int")))
    near = listed.filter(F.col("bits") >= NEAR_BITS).select(
        _leading(F.call_function("shiftleft", F.col("net"), F.lit(32) - F.col("bits")), F.lit(NEAR_BITS)).alias("block"),
        F.call_function("shiftleft", F.col("net"), F.lit(32) - F.col("bits")).alias("low"),
        (F.call_function("shiftleft", F.col("net") + 1, F.lit(32) - F.col("bits")) - 1).alias("high"),
        F.col("ip").alias("feed_entry"),
        *ENTRY,
    )
    far = listed.filter(F.col("bits") < NEAR_BITS).select("bits", "net", F.col("ip").alias("feed_entry"), *ENTRY)
    ends, names = _ends(packets), FOUND
    if counted:
        ends = cut_lineage(ends.groupBy("direction", "ip").agg(F.count(F.lit(1)).alias("packets")))
        names = ("direction", "ip", "feed_entry", *ENTRY, "packets")
    ends = ends.withColumn("_n", ipv4_number(F.col("ip"))).filter(F.col("_n").isNotNull())
    close = _marked(ends, block_marks(near.select("block").distinct()), NEAR_BITS)
    found = close.join(near, (close["block"] == near["block"]) & close["_n"].between(near["low"], near["high"])).select(*names)
    lengths = [r["bits"] for r in far.select("bits").distinct().collect()]  # at most 24
    if not lengths:
        return found
    # the blocks of a range wider than 16 bits, or the one that a narrower range lies in
    up = lambda by: F.call_function("shiftleft", F.col("net") + by, F.lit(FAR_BITS) - F.col("bits"))
    inside = F.sequence(up(0), up(1) - 1)
    blocks = far.select("bits", "net").distinct().select(
        F.explode(F.when(F.col("bits") <= FAR_BITS, inside).otherwise(F.array(F.call_function("shiftright", F.col("net"), F.col("bits") - FAR_BITS)))).alias("block")
    )
    wide = _marked(ends, block_marks(blocks.distinct()), FAR_BITS).drop("block")
    return found.unionByName(_by_length(wide, far, sorted(lengths)).select(*names))
