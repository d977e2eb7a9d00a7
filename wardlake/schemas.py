"""Declared schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

PROCESS_DETAILS = T.StructType(
    [
        T.StructField("Image", T.StringType()),
        T.StructField("CommandLine", T.StringType()),
        T.StructField("User", T.StringType()),
        T.StructField("ParentImage", T.StringType()),
        T.StructField("ProcessId", T.StringType()),
    ]
)

#: What names an event: record numbers are given per host and channel.
RECORD = ("host", "log_source", "record_id")

RAW_EVENT = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("record_id", T.LongType(), False),
        T.StructField("log_source", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("event_time", T.TimestampType(), False),
        T.StructField("message", T.StringType()),
        T.StructField("inserts", T.ArrayType(T.StringType())),
        T.StructField("xml", T.StringType()),
    ]
)

#: ``risk_score`` is canonical English, ``risk_score_raw`` the label as it was given.
STORED_LOG = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("log_source", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("event_id", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("ai_analysis", T.StringType()),
        T.StructField("risk_score", T.StringType()),
        T.StructField("risk_score_raw", T.StringType()),
        T.StructField("mitre_technique", T.StringType()),
    ]
)

THREAT_FEED = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("confidence", T.IntegerType()),
    ]
)

KNOWLEDGE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("advice", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

PACKET = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("summary", T.StringType()),
    ]
)

CONNECTION = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("proto", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("pid", T.LongType()),
    ]
)

PROCESS = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("application", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

PORT_CATALOGUE = T.StructType(
    [
        T.StructField("port", T.IntegerType()),
        T.StructField("service", T.StringType()),
        T.StructField("risk", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("priority", T.IntegerType()),
    ]
)

BLOCK_LIST = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("events", T.LongType()),
    ]
)

#: ``answered_at`` orders answers to one event; the last one counts.
ANSWER = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("log_source", T.StringType()),
        T.StructField("record_id", T.LongType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("answered_at", T.TimestampType()),
        T.StructField("raw_response", T.StringType()),
    ]
)

RULE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("severity", T.StringType()),
        T.StructField("mitre", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("event_id", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("message_regex", T.StringType()),
        T.StructField("command_line_regex", T.StringType()),
        T.StructField("image_regex", T.StringType()),
        T.StructField("parent_image_regex", T.StringType()),
        T.StructField("time_window", T.IntegerType()),
        T.StructField("threshold", T.IntegerType()),
        T.StructField("match_message", T.StringType()),
        T.StructField("exclude_users", T.ArrayType(T.StringType())),
        T.StructField("include_users", T.ArrayType(T.StringType())),
        T.StructField("rule_file", T.StringType()),
        T.StructField("idx", T.IntegerType()),
    ]
)

#: The entry of the feed that a record meets.
THREAT = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("confidence", T.IntegerType()),
    ]
)

#: What a rule reports where it matches.
RESULT = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("mitre_technique", T.StringType()),
        T.StructField("mitre_techniques", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("match_message", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)
