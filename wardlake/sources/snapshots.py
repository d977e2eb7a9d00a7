"""Packet, connection and process tables, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlake import schemas


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.PACKET).format(fmt).load(path)


def stream_packets(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.PACKET).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def read_connections(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.CONNECTION).format(fmt).load(path)


def read_processes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.PROCESS).format(fmt).load(path)


def listening(connections: DataFrame) -> DataFrame:
    """TCP sockets in LISTEN state."""
    return connections.filter((F.col("proto") == "tcp") & (F.col("state") == "LISTEN"))


def flatten_packets(decoded: DataFrame) -> DataFrame:
    """Decoded packets, with one nullable struct per layer, as packet rows.

    With an IP layer: TCP or UDP give name and destination port, ICMP its name,
    anything else the protocol number as text. Without one: hardware addresses
    and 'Ethernet'. Layers of ``decoded``: ``ip(src, dst, proto)``,
    ``tcp(dport)``, ``udp(dport)``, ``icmp(type)``, ``eth(src, dst)``.
    """
    has = lambda layer: F.col(layer).isNotNull()

    def by_layer(with_ip: Column, without: Column) -> Column:
        return F.when(has("ip"), with_ip).when(has("eth"), without)

    name = (
        F.when(has("tcp"), "TCP")
        .when(has("udp"), "UDP")
        .when(has("icmp"), "ICMP")
        .otherwise(F.col("ip.proto").cast("string"))
    )
    port = F.when(has("ip"), F.coalesce("tcp.dport", "udp.dport"))
    return decoded.select(
        "seq",
        "ts",
        by_layer(F.col("ip.src"), F.col("eth.src")).alias("source_ip"),
        by_layer(F.col("ip.dst"), F.col("eth.dst")).alias("dest_ip"),
        by_layer(name, F.lit("Ethernet")).alias("protocol"),
        port.cast("int").alias("port"),
        F.col("length").cast("int").alias("length"),
        "summary",
    )
