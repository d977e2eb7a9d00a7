"""The stored log table: create, append, scan, clear, export, archive import."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from wardlake import schemas
from wardlake.functions.risk import canonical_risk, severity_label
from wardlake.session import folders

#: Partition columns: day for pruning, batch for repeatable streaming writes.
PARTITIONS = ("log_date", "batch")
#: Folder of rows without a time.
NO_DAY = "log_date=__HIVE_DEFAULT_PARTITION__"

# Header of archived log files, in column order.
ARCHIVE_HEADER = ("ID", "Zaman", "Event ID", "Mesaj", "AI Analiz", "Risk Seviyesi")

LOG_COLUMNS = schemas.STORED_LOG.fieldNames()


def conform(logs: DataFrame) -> DataFrame:
    """Rows in the stored schema; columns an older table lacks become NULL."""
    if "risk_score_raw" not in logs.columns and "risk_score" in logs.columns:
        logs = logs.withColumn("risk_score_raw", F.col("risk_score"))
    empty = logs.sparkSession.createDataFrame([], schemas.STORED_LOG)
    full = empty.unionByName(logs, allowMissingColumns=True)
    return full.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.STORED_LOG]
    )


def to_stored(logs: DataFrame) -> DataFrame:
    """Rows as they are written: time cut to seconds, rows without a time refused."""
    return conform(logs).withColumn("timestamp", F.date_trunc("second", "timestamp"))


def _partitioned(logs: DataFrame, batch: str) -> DataFrame:
    return to_stored(logs).withColumn("log_date", F.to_date("timestamp")).withColumn(
        "batch", F.lit(batch)
    )


def create_table(spark: SparkSession, path: str) -> None:
    """An empty table where there is none; an existing one is left alone."""
    try:
        spark.read.parquet(path).schema
    except AnalysisException:
        clear(spark, path)


def append(logs: DataFrame, path: str, batch: str = "manual") -> None:
    """Append rows; their ``id`` is the stable record id."""
    _partitioned(logs, batch).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def append_batch(logs: DataFrame, path: str, batch: str) -> None:
    """Write a micro-batch so that a repeated attempt replaces its own rows only.

    Rows of a day come together, in tasks of even size, so a day has few files.
    """
    (
        _partitioned(logs, batch)
        .hint("rebalance", "log_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """The table, with columns added later filled with NULL in older files.

    ``since`` (included) and ``until`` (excluded) bound the time; only the days
    between them are read.
    """
    stored = _stored(spark, path)
    if since is not None:
        stored = stored.filter((F.col("log_date") >= F.to_date(F.lit(since))) & (F.col("timestamp") >= F.lit(since)))
    if until is not None:
        stored = stored.filter((F.col("log_date") <= F.to_date(F.lit(until))) & (F.col("timestamp") < F.lit(until)))
    return _shown(stored)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """Rows with their partition columns; the schema is declared, so no file is opened for it."""
    fields = [*schemas.STORED_LOG.fields, T.StructField("log_date", T.DateType()), T.StructField("batch", T.StringType())]
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in fields])).parquet(path)


def _shown(stored: DataFrame) -> DataFrame:
    return stored.withColumn("risk_score_raw", F.coalesce("risk_score_raw", "risk_score")).drop(*PARTITIONS)


def read_newest(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The newest rows, ties by id, from as few days as hold them.

    Days are counted from the last one back, by the footers of their files, until
    there are enough; rows without a time come last. Only those days are read.
    """
    names = [f for f in folders(spark, path) if f.startswith("log_date=")]
    days = sorted((f for f in names if f != NO_DAY), reverse=True) + [f for f in names if f == NO_DAY]
    chosen, found = F.lit(False), 0
    for day in days:
        mine = F.col("log_date").isNull() if day == NO_DAY else F.col("log_date") == F.lit(day.split("=")[1]).cast("date")
        chosen = chosen | mine
        found += _stored(spark, path).filter(mine).count()
        if found >= rows:
            break
    return scan(_shown(_stored(spark, path).filter(chosen)), rows)


def clear(spark: SparkSession, path: str) -> None:
    """Delete all rows and keep the schema."""
    empty = spark.createDataFrame([], schemas.STORED_LOG)
    empty.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def scan(logs: DataFrame, limit: int | None = None, newest_first: bool = True) -> DataFrame:
    """Rows by time, ties by id; a limit keeps only the first of them."""
    if newest_first:
        ordered = logs.orderBy(F.desc("timestamp"), F.desc("id"))
    else:
        ordered = logs.orderBy(F.asc("timestamp"), F.asc("id"))
    return ordered.limit(limit) if limit else ordered


def export_csv(logs: DataFrame, directory: str, now: datetime | None = None) -> str:
    """Write the rows and their severity as CSV files with a header, texts as they are; returns the folder."""
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    target = f"{directory.rstrip('/')}/logs_{stamp}.csv"
    (
        logs.withColumn("severity", severity_label(F.col("risk_score")))
        .write.option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(target)
    )
    return target


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files as texts, headers left out: ``record``; quoted fields may have several lines.

    A file is read by as many tasks as it has blocks. A line begins a record where
    an even number of quotes stands before it in its file; that number is the sum
    of those of the blocks before, a small table, and of the lines before in the
    same block. Lines of one record then come together, whichever blocks they are in.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    lines = lines.withColumn("_quotes", F.length("value") - F.length(F.translate("value", '"', "")))
    within, places = Window.partitionBy("_file", "_block").orderBy("_line"), Window.partitionBy("_file").orderBy("_block")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def totals(rows: DataFrame, c: str) -> DataFrame:
        blocks = rows.groupBy("_file", "_block").agg(F.sum(c).alias("_n"))
        return blocks.select("_file", "_block", before("_n", places).alias("_base"))

    opened = lines.join(totals(lines, "_quotes"), ["_file", "_block"])
    opened = opened.withColumn("_first", ((F.col("_base") + before("_quotes", within)) % 2 == 0).cast("long")).drop("_base")
    numbered = opened.join(totals(opened, "_first"), ["_file", "_block"])
    number = F.col("_base") + F.sum("_first").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = numbered.select("_file", "_block", "_line", "value", number.alias("_record")).filter("_record > 1")
    parts = numbered.groupBy("_file", "_record").agg(F.array_sort(F.collect_list(F.struct("_block", "_line", "value"))).alias("_p"))
    text = F.array_join("_p.value", "\n")
    # the line end of the record goes; inside quotes it becomes the plain one, and others stay
    whole = F.when(text.endswith("\r"), F.regexp_replace(text, r"\r(?=\n|\z)", "")).otherwise(text)
    return parts.select(whole.alias("record")).filter("record <> ''")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archived logs: CSV with quoted multi-line messages, in the stored schema; a large file is read by many tasks."""
    options = {"escape": '"', "encoding": "UTF-8"}
    header = spark.read.options(header=True, **options).csv(path).columns
    raw = csv_records(spark, path).select(F.from_csv("record", ", ".join(f"`{c}` string" for c in header), options | {"multiLine": "true"}).alias("_r")).select("_r.*")
    for have, want in zip(ARCHIVE_HEADER, ("id", "timestamp", "event_id", "message", "ai_analysis", "risk")):
        raw = raw.withColumnRenamed(have, want)
    return conform(
        raw.select(
            F.col("id").try_cast("long").alias("id"),
            F.try_to_timestamp("timestamp").alias("timestamp"),
            "event_id",
            "message",
            "ai_analysis",
            canonical_risk(F.col("risk")).alias("risk_score"),
            F.col("risk").alias("risk_score_raw"),
        )
    )
