"""Event channels: batch and streaming reads, merging, incremental reads, preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlake import schemas
from wardlake.functions import text

# Seconds read again before the last check, and between two checks.
OVERLAP_SECONDS = 5
POLL_SECONDS = 5

EVENT_ORDER = ("event_time", "log_source", "record_id", "host")


def _columns(df: DataFrame, log_source: str | None) -> DataFrame:
    names = schemas.RAW_EVENT.fieldNames()
    if log_source is not None:
        df = df.withColumn("log_source", F.lit(log_source))
    return df.select(*names)


def read_channel(
    spark: SparkSession, path: str, log_source: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """One channel as a table; ``log_source`` tags its rows."""
    return _columns(spark.read.schema(schemas.RAW_EVENT).format(fmt).load(path), log_source)


def stream_channel(
    spark: SparkSession,
    path: str,
    log_source: str | None = None,
    fmt: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    """One channel as a stream of files."""
    reader = spark.readStream.schema(schemas.RAW_EVENT).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _columns(reader.load(path), log_source)


def merge_channels(*channels: DataFrame) -> DataFrame:
    """All channels as one table.

    Time order across channels is carried by ``EVENT_ORDER``, which windows and
    counts sort by; the rows themselves are not sorted globally.
    """
    merged = channels[0]
    for channel in channels[1:]:
        merged = merged.unionByName(channel, allowMissingColumns=True)
    return merged


def since(events: DataFrame, last_check, overlap_seconds: int = OVERLAP_SECONDS) -> DataFrame:
    """Events after ``last_check`` minus the overlap (strictly)."""
    cutoff = F.lit(last_check).cast("timestamp") - F.make_interval(secs=F.lit(overlap_seconds))
    return events.filter(F.col("event_time") > cutoff)


def in_time_order(events: DataFrame) -> DataFrame:
    """Add ``arrival``: the sortable place of an event among all channels."""
    return events.withColumn("arrival", F.struct(*EVENT_ORDER))


def prepare(events: DataFrame, positional_strict: bool = False) -> DataFrame:
    """Choose the message, parse process details, build the searched text.

    Empty inserts are dropped before positions are counted, so a process field
    may shift; ``positional_strict`` counts positions in the raw list instead.
    """
    source, code, inserts = F.col("log_source"), F.col("event_id"), F.col("inserts")
    data = F.lit(None).cast("array<struct<_Name:string,_VALUE:string>>")
    if "xml" in events.columns:
        data = text.xml_data(source, code, inserts, F.col("xml"))
    # Used several times below, so they get a projection of their own.
    once = events.withColumns(
        {
            "message": text.event_message(F.col("message"), inserts),
            "_values": text.non_empty(inserts),
            "_data": data,
        }
    )
    values = inserts if positional_strict else F.col("_values")
    detailed = once.withColumn(
        "details", text.process_details(source, code, values, F.col("_data"))
    )
    combined = text.combined_text(F.col("message"), code, F.col("details"), F.col("_values"))
    return detailed.withColumn("combined_text", combined).drop("_values", "_data")
