"""Block list: derivation, anti-join against what is blocked, removal. Nothing is run on a host."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlake import schemas
from wardlake.functions.ip import block_rule_name, is_private_ip, is_valid_ipv4
from wardlake.functions.risk import is_high


def not_blocked(ips: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows whose address is not on the block list yet."""
    return ips.join(blocked.select("ip"), "ip", "left_anti")


def block_candidates(events: DataFrame, risk_col: str = "final_risk_raw") -> DataFrame:
    """Public addresses of high-risk events with first time and number of events.

    Each event counts an address once. The count is partly aggregated before
    the shuffle, so an address found everywhere stays small.
    """
    high = events.filter(is_high(F.col(risk_col)))
    listed = high.select("event_time", F.explode_outer(F.array_distinct("public_ips")).alias("ip"))
    return listed.filter(F.col("ip").isNotNull()).groupBy("ip").agg(
        F.min("event_time").alias("first_seen"), F.count(F.lit(1)).alias("events")
    )


def new_blocks(events: DataFrame, blocked: DataFrame, risk_col: str = "final_risk_raw") -> DataFrame:
    """Block-list rows to add."""
    fresh = not_blocked(block_candidates(events, risk_col), blocked)
    return fresh.select(
        "ip", block_rule_name(F.col("ip")).alias("rule_name"), "first_seen", "events"
    )


def manual_blocks(requests: DataFrame, blocked: DataFrame) -> DataFrame:
    """Requested addresses that may be blocked: valid, public, not blocked yet."""
    wanted = requests.filter(is_valid_ipv4(F.col("ip")) & ~is_private_ip(F.col("ip")))
    first = wanted.groupBy("ip").agg(F.min("event_time").alias("first_seen"))
    return not_blocked(first, blocked).select(
        "ip",
        block_rule_name(F.col("ip")).alias("rule_name"),
        "first_seen",
        F.lit(0).cast("long").alias("events"),
    )


def unblock(blocked: DataFrame, released: DataFrame) -> DataFrame:
    """The block list without the released addresses."""
    return blocked.join(released.select("ip").distinct(), "ip", "left_anti")


def empty_block_list(spark) -> DataFrame:
    return spark.createDataFrame([], schemas.BLOCK_LIST)
