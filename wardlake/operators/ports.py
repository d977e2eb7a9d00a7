"""Open ports: catalogue lookup, application names, risk summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlake import schemas
from wardlake.functions.risk import is_high
from wardlake.sources.snapshots import listening

# Ports to watch, and common ports of low risk.
HIGH_RISK_PORTS = {
    21: "FTP", 23: "Telnet", 445: "SMB", 3389: "RDP", 1433: "MSSQL", 3306: "MySQL",
    5432: "PostgreSQL", 5900: "VNC", 8080: "HTTP Proxy", 135: "MSRPC", 139: "NetBIOS",
}
KNOWN_SAFE_PORTS = {
    80: "HTTP", 443: "HTTPS", 22: "SSH", 25: "SMTP", 53: "DNS",
    110: "POP3", 143: "IMAP", 993: "IMAPS", 995: "POP3S",
}
# Description per kind of port.
WATCH = " service - Should be carefully monitored from security perspective"
SAFE = " service - Generally safe"
NAMED = " service"
UNKNOWN_SERVICE = "Unknown service"

DIGEST_PORTS = 10
MAX_PORT = 65535


def port_catalogue(spark: SparkSession, services: DataFrame | None = None) -> DataFrame:
    """One row per port: watched ports, then common ones, then named services."""
    rows = [(p, n, "High", n + WATCH, 1) for p, n in HIGH_RISK_PORTS.items()]
    rows += [(p, n, "Low", n + SAFE, 2) for p, n in KNOWN_SAFE_PORTS.items()]
    fixed = spark.createDataFrame(rows, schemas.PORT_CATALOGUE)
    if services is None:
        return fixed
    name = F.upper("service")
    # Port numbers have 16 bits, which bounds the catalogue whatever the input.
    named = services.filter(F.col("port").between(0, MAX_PORT)).select(
        F.col("port").cast("int").alias("port"),
        name.alias("service"),
        F.lit("Low").alias("risk"),
        F.concat(name, F.lit(NAMED)).alias("description"),
        F.lit(3).alias("priority"),
    )
    best = F.min_by(
        F.struct("service", "risk", "description", "priority"), F.struct("priority", "service")
    )
    return (
        fixed.unionByName(named).groupBy("port").agg(best.alias("_b")).select("port", "_b.*")
    )


def with_port_info(ports: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add ``service, risk, description``; a port outside the catalogue is unknown and low.

    The catalogue has one row per port, so at most 65,536, and is broadcast.
    """
    dim = catalogue.select(
        "port",
        F.col("service").alias("_s"),
        F.col("risk").alias("_r"),
        F.col("description").alias("_d"),
    )
    return (
        ports.join(F.broadcast(dim), "port", "left")
        .withColumn("service", F.coalesce("_s", F.lit("Unknown")))
        .withColumn("risk", F.coalesce("_r", F.lit("Low")))
        .withColumn("description", F.coalesce("_d", F.lit(UNKNOWN_SERVICE)))
        .drop("_s", "_r", "_d")
    )


def with_application(ports: DataFrame, processes: DataFrame) -> DataFrame:
    """Add ``application`` by host and process id.

    'Unknown' without a process id (or 0), 'Access Denied' where the id names no
    process. Of several snapshots of one process the last counts.
    """
    seen = F.col("ts") if "ts" in processes.columns else F.lit(None).cast("timestamp")
    last = F.max_by("application", F.struct(seen.alias("ts"), F.col("application").alias("a")))
    named = processes.groupBy("host", "pid").agg(last.alias("_a"))
    unnamed = F.when(F.col("pid").isNull() | (F.col("pid") == 0), "Unknown").otherwise("Access Denied")
    return (
        ports.join(named, ["host", "pid"], "left")
        .withColumn("application", F.when(F.col("pid") == 0, "Unknown").otherwise(F.coalesce("_a", unnamed)))
        .drop("_a")
    )


def open_ports(connections: DataFrame, catalogue: DataFrame, processes: DataFrame) -> DataFrame:
    """Listening TCP ports with application, service, risk and description."""
    found = with_application(with_port_info(listening(connections), catalogue), processes)
    return found.select(
        "host", "port", "pid", "application", "service", "risk", "description"
    )


def by_port(ports: DataFrame) -> DataFrame:
    """Ports ascending, for reading."""
    return ports.orderBy("port", "host", "pid")


def port_summary(ports: DataFrame) -> DataFrame:
    """All, high-risk and remaining ports."""
    high = F.count_if(is_high(F.col("risk")))
    return ports.agg(
        F.count(F.lit(1)).alias("total"),
        high.alias("high_risk"),
        (F.count(F.lit(1)) - high).alias("low_risk"),
    )


def high_risk_ports(ports: DataFrame, n: int = DIGEST_PORTS) -> DataFrame:
    """The first ``n`` high-risk ports by number."""
    return ports.filter(is_high(F.col("risk"))).orderBy("port", "host", "pid").limit(n)
