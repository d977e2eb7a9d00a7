"""System digest: recent high-risk logs and risky ports as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardlake.functions.text import DIGEST_CHARS
from wardlake.operators.ports import high_risk_ports, port_summary
from wardlake.operators.reports import high_risk_digest

# Headings and placeholders of the digest.
LOGS_HEADING = "=== HIGH RISK LOGS ==="
PORTS_HEADING = "=== HIGH RISK OPEN PORTS ==="
NO_PORTS_HEADING = "=== OPEN PORTS ==="
NO_LOGS = "No high-risk logs found."
NO_PORTS = "No high-risk open ports found."


def _or(column: str, text: str) -> Column:
    return F.when(F.col(column) != "", F.col(column)).otherwise(text)


def _log_line() -> Column:
    return F.concat(
        F.lit("- Event ID "),
        F.coalesce("event_id", F.lit("None")),
        F.lit(" (Time: "),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
        F.lit(")\n  Message: "),
        F.left(_or("message", "No message"), F.lit(DIGEST_CHARS)),
        F.lit("\n  AI Analysis: "),
        F.left(_or("ai_analysis", "No analysis"), F.lit(DIGEST_CHARS)),
        F.lit("\n  Risk: "),
        F.col("risk_score_raw"),
        F.lit("\n"),
    )


def _port_line() -> Column:
    return F.concat(
        F.lit("- Port "),
        F.col("port").cast("string"),
        F.lit(" ("),
        F.col("service"),
        F.lit(")\n  PID: "),
        F.coalesce(F.col("pid").cast("string"), F.lit("N/A")),
        F.lit("\n  Application: "),
        F.col("application"),
        F.lit("\n  Description: "),
        F.col("description"),
        F.lit("\n"),
    )


def _section(number: int, lines: DataFrame, heading: str, empty_heading: str, empty: str) -> DataFrame:
    """Rows of one section from at most ten lines ``(key, line)``."""
    listed = lines.agg(F.sort_array(F.collect_list(F.struct("key", "line"))).alias("l"))
    texts = F.transform("l", lambda x: x["line"])
    full = F.concat(F.array(F.lit(heading)), texts)
    none = F.array(F.lit(empty_heading), F.lit(empty))
    return listed.select(
        F.lit(number).alias("section"),
        F.posexplode(F.when(F.size("l") > 0, full).otherwise(none)).alias("line_no", "text"),
    )


def system_digest(logs: DataFrame, ports: DataFrame) -> DataFrame:
    """Digest rows ``section, line_no, text``."""
    newest_first = F.struct(
        (-F.unix_micros("timestamp")).alias("a"), (-F.col("id")).alias("b")
    )
    log_lines = high_risk_digest(logs).select(newest_first.alias("key"), _log_line().alias("line"))
    port_lines = high_risk_ports(ports).select(
        F.struct("port", "host", "pid").alias("key"), _port_line().alias("line")
    )
    totals = port_summary(ports).filter(F.col("total") > 0)
    total_line = F.format_string(
        "Total Open Ports: %d\nHigh Risk: %d\nLow Risk: %d\n", "total", "high_risk", "low_risk"
    )
    return (
        _section(1, log_lines, LOGS_HEADING, LOGS_HEADING, NO_LOGS)
        .unionByName(_section(2, port_lines, PORTS_HEADING, NO_PORTS_HEADING, NO_PORTS))
        .unionByName(
            totals.select(
                F.lit(3).alias("section"), F.lit(0).alias("line_no"), total_line.alias("text")
            )
        )
    )
