"""Questions to the stored log table: counts, timeline, distributions, filters, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlake.operators.rules import spark_pattern
from wardlake.functions.risk import (
    canonical_risk,
    display_risk,
    is_high,
    risk_bucket,
    severity_label,
)
from wardlake.functions.text import strip
from wardlake.sources.logs import scan

# Rows on the dashboard, timeline step, digest sizes.
DASHBOARD_ROWS = 1000
TIMELINE_STEP = "15 minutes"
DIGEST_SCAN = 50
DIGEST_ROWS = 10


def metrics(logs: DataFrame) -> DataFrame:
    """Total rows, high-risk rows and latest time in one pass."""
    return logs.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_if(is_high(F.col("risk_score"))).alias("high_risk_logs"),
        F.max("timestamp").alias("latest_detection"),
    )


def total_count(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count(F.lit(1)).alias("total_logs"))


def high_risk_count(logs: DataFrame, label_col: str = "risk_score") -> DataFrame:
    """Rows labelled exactly with one of the two spellings of High."""
    return logs.agg(F.count_if(is_high(F.col(label_col))).alias("high_risk_logs"))


def latest_detection(logs: DataFrame) -> DataFrame:
    return logs.agg(F.max("timestamp").alias("latest_detection"))


def timeline(logs: DataFrame, step: str = TIMELINE_STEP, time_col: str = "timestamp") -> DataFrame:
    """Rows per floor bucket; rows without a readable time are left out."""
    time = F.col(time_col)
    if logs.schema[time_col].dataType.typeName() == "string":
        time = F.try_to_timestamp(time)
    return (
        logs.select(time.alias("_t"))
        .filter(F.col("_t").isNotNull())
        .groupBy(F.window("_t", step).alias("_w"))
        .agg(F.count(F.lit(1)).alias("log_count"))
        .select(F.col("_w.start").alias("time_interval"), "log_count")
    )


def risk_distribution(logs: DataFrame, label_col: str = "risk_score") -> DataFrame:
    """Rows per High / Medium / Low / Unspecified."""
    return logs.groupBy(risk_bucket(F.col(label_col)).alias("risk_level")).agg(
        F.count(F.lit(1)).alias("log_count")
    )


def technique_counts(logs: DataFrame) -> DataFrame:
    """Rows per technique; a row may list several, separated by commas."""
    listed = logs.select(
        F.explode_outer(F.split("mitre_technique", r"\s*,\s*")).alias("technique")
    ).filter(F.col("technique") != "")
    return listed.groupBy("technique").agg(F.count(F.lit(1)).alias("log_count"))


def newest(logs: DataFrame, rows: int = DASHBOARD_ROWS) -> DataFrame:
    """The newest rows, for the dashboard."""
    return scan(logs, rows)


def high_risk_digest(logs: DataFrame, scanned: int = DIGEST_SCAN, rows: int = DIGEST_ROWS) -> DataFrame:
    """High-risk rows among the newest ``scanned``, at most ``rows``: limit first, then filter."""
    label = F.lower(strip(F.col("risk_score_raw")))
    recent = scan(logs, scanned).filter(label.isin("high", "yüksek"))
    return scan(recent, rows)


def filter_risk(logs: DataFrame, levels: list[str]) -> DataFrame:
    """Rows whose English label contains one of the chosen ones (any case)."""
    if not levels:
        return logs
    label = canonical_risk(F.col("risk_score"))
    return logs.filter(F.coalesce(label.rlike("(?iU)" + spark_pattern("|".join(levels))), F.lit(False)))


def filter_event_id(logs: DataFrame, pattern: str | None) -> DataFrame:
    """Rows whose event id matches a pattern anywhere (any case)."""
    if not pattern:
        return logs
    return logs.filter(F.coalesce(F.col("event_id").rlike("(?iU)" + spark_pattern(pattern)), F.lit(False)))


def search(logs: DataFrame, term: str | None) -> DataFrame:
    """Rows with the term, used as a pattern, in message, analysis or technique; NULL never matches."""
    wanted = (term or "").strip().lower()
    if not wanted:
        return logs
    hit = F.lit(False)
    for name in ("message", "ai_analysis", "mitre_technique"):
        hit = hit | F.coalesce(F.lower(name).rlike("(?Ud)" + spark_pattern(wanted)), F.lit(False))
    return logs.filter(hit)


def filter_logs(
    logs: DataFrame,
    levels: list[str] | None = None,
    event_id: str | None = None,
    term: str | None = None,
) -> DataFrame:
    """All three filters together; an empty one changes nothing."""
    return search(filter_event_id(filter_risk(logs, levels or []), event_id), term)


def with_severity(logs: DataFrame, label_col: str = "risk_score") -> DataFrame:
    return logs.withColumn("severity", severity_label(F.col(label_col)))


def log_view(logs: DataFrame, label_col: str = "risk_score") -> DataFrame:
    """Table view: time, event id, severity, risk, technique, message."""
    severity = severity_label(F.col(label_col))
    return logs.select(
        F.col("timestamp").alias("time"),
        "event_id",
        display_risk(severity).alias("severity"),
        display_risk(F.col(label_col)).alias("risk_level"),
        "mitre_technique",
        "message",
    )
