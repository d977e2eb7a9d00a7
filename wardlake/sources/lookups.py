"""Lookup files: threat feed and event knowledge."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlake import schemas
from wardlake.functions.text import strip

_KNOWN = "title string, description string, risk_level string, advice string"
_OUTSIDE = (
    "eventID string, name string, subCategory string, description string, level string, "
    "securityMonitoringRecommandation string, advice string, recommendation string"
)

# What a local entry gets for a missing risk or advice, and what
# an outside entry gets for a missing advice.
LOCAL_RISK = "Yüksek"
LOCAL_ADVICE = "Bu olay özel olarak tanımlanmıştır."
OUTSIDE_ADVICE = "Olayın kaynağını ve kullanıcıyı doğrulayın."


def clean_feed(raw: DataFrame, order_col: str = "row_no") -> DataFrame:
    """Feed rows worth looking up, one per address.

    Trims the fields, drops benign and zero-confidence rows, rows without an
    address and rows whose confidence is no whole number; the last row of an
    address wins.
    """
    trimmed = raw.select(
        strip(F.col("ip")).alias("ip"),
        strip(F.coalesce("category", F.lit("Unknown"))).alias("category"),
        strip(F.col("confidence").cast("string")).try_cast("int").alias("confidence"),
        F.col(order_col).alias("_order"),
    )
    kept = trimmed.filter(
        (F.col("ip") != "") & (F.lower("category") != "benign") & (F.col("confidence") != 0)
    )
    last = F.max_by(F.struct("category", "confidence"), "_order")
    return kept.groupBy("ip").agg(last.alias("_last")).select("ip", "_last.category", "_last.confidence")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The feed of a CSV file with header; a missing file is an empty feed."""
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schemas.THREAT_FEED)
    for name, default in (("ip", ""), ("category", "Unknown"), ("confidence", "0")):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(default))
    place = F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )
    return clean_feed(raw.withColumn("row_no", place))


def feed_size(feed: DataFrame) -> DataFrame:
    """Number of addresses in the feed."""
    return feed.agg(F.count_distinct("ip").alias("malicious_ips"))


def local_knowledge(entries: DataFrame) -> DataFrame:
    """Own entries ``event_id, title, description, risk_level, advice`` with defaults."""
    return entries.select(
        "event_id",
        "title",
        "description",
        F.coalesce("risk_level", F.lit(LOCAL_RISK)).alias("risk_level"),
        F.coalesce("advice", F.lit(LOCAL_ADVICE)).alias("advice"),
        F.lit("local").alias("source"),
    )


def external_knowledge(entries: DataFrame, order_col: str | None = None) -> DataFrame:
    """Outside entries brought to the same columns.

    Entries without an event id are dropped; of several entries with one id the
    last by ``order_col`` wins.
    """
    keyed = entries.withColumn("event_id", strip(F.col("eventID"))).filter(F.col("event_id") != "")
    if order_col:
        names = [c for c in keyed.columns if c not in ("event_id", order_col)]
        keyed = (
            keyed.groupBy("event_id")
            .agg(F.max_by(F.struct(*names), order_col).alias("_e"))
            .select("event_id", "_e.*")
        )
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    advised = F.lower(F.coalesce("securityMonitoringRecommandation", F.lit("")))
    level = F.lower(F.coalesce("level", F.lit("")))
    return keyed.select(
        "event_id",
        F.coalesce(
            filled("name"), filled("subCategory"), F.concat(F.lit("Event "), F.col("eventID"))
        ).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        # Words that decide the risk, and the labels.
        F.when(advised.contains("yes") | advised.contains("true"), "Yüksek")
        .when(level.contains("error") | level.contains("critical"), "Yüksek")
        .when(level.contains("information"), "Düşük")
        .otherwise("Orta")
        .alias("risk_level"),
        F.coalesce("advice", "recommendation", F.lit(OUTSIDE_ADVICE)).alias("advice"),
        F.lit("external").alias("source"),
    )


def merge_knowledge(local: DataFrame, external: DataFrame) -> DataFrame:
    """One row per event id; own entries win over outside ones."""
    return local.unionByName(external.join(local, "event_id", "left_anti"))


def read_local_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Own entries from a JSON object keyed by event id."""
    try:
        content = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        return spark.createDataFrame([], schemas.KNOWLEDGE)
    entries = content.select(
        F.explode(F.from_json("value", f"map<string,struct<{_ddl(_KNOWN)}>>"))
    ).select(F.col("key").alias("event_id"), "value.*")
    return local_knowledge(entries)


def read_external_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Outside entries from a JSON list, or from an object keyed by event id."""
    try:
        content = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        return spark.createDataFrame([], schemas.KNOWLEDGE)
    entry = f"struct<{_ddl(_OUTSIDE)}>"
    is_list = F.ltrim("value").startswith("[")
    listed = content.filter(is_list).select(
        F.posexplode(F.from_json("value", f"array<{entry}>")).alias("place", "e")
    )
    keyed = content.filter(~is_list).select(
        F.explode(F.from_json("value", f"map<string,{entry}>")).alias("key", "e")
    )
    from_list = external_knowledge(listed.select("place", "e.*"), "place")
    from_map = external_knowledge(
        keyed.select("e.*", "key").withColumn("eventID", F.col("key")).drop("key")
    )
    return from_list.unionByName(from_map)


def _ddl(columns: str) -> str:
    return ",".join(c.strip().replace(" ", ":", 1) for c in columns.split(","))
