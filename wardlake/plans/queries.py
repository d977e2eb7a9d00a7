"""Registered queries: every operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlake.functions import ip as ipf
from wardlake.functions import risk, text
from wardlake.operators import detect, enrich, fuse, ports, reports, respond, traffic
from wardlake.operators.rules import Rule, rule_from_dict, rules_frame, catalogue_counts
from wardlake.plans import adapters as A
from wardlake.plans import digest, process
from wardlake import schemas
from wardlake.session import cut_lineage, shared_dir, use_utc
from wardlake.sources import events as ev
from wardlake.sources import logs as store
from wardlake.sources import lookups, snapshots
from wardlake.streaming import jobs

#: Files of one part of the events at least, so that all executors write and read it.
FILES = 3
#: Rows of one file of packets, and of one of events, which one task writes and reads.
FILE_ROWS, EVENT_ROWS = 1_000_000, 200_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def _us(column: str = "event_time") -> Column:
    return F.unix_micros(F.col(column))


def _time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _joined(column) -> Column:
    return F.array_join(column, ",")


# --- rules used by the queries -------------------------------------------------

BRUTE_FORCE = {
    "id": "bf",
    "name": "Failed logons",
    "severity": "high",
    "mitre": ["T1110", "T1110.001"],
    "tags": ["auth"],
    "match_message": "Many failed logons",
    "conditions": {"event_id": 4625, "provider": "security", "time_window": 7200, "threshold": 8},
}
FINE = {
    "id": "fine",
    "name": "Repeated interpreters",
    "severity": "Critical",
    "mitre": "T1059",
    "match_message": "Interpreter started again and again",
    "conditions": {"event_id": "1", "image_regex": r"cmd|powershell", "time_window": 14400, "threshold": 4},
}
COARSE = {
    "id": "coarse",
    "name": "Many processes",
    "severity": "high",
    "conditions": {"event_id": "1", "time_window": 7200, "threshold": 5},
}
ENCODED = {
    "id": "encoded",
    "name": "Encoded command",
    "severity": "high",
    "mitre": ["T1027"],
    "conditions": {"provider": "Sysmon", "event_id": "1", "command_line_regex": r"-EncodedCommand|-e\s+[A-Za-z0-9+/=]+"},
}
PRIVILEGES = {
    "id": "privileges",
    "name": "Privileges for some users",
    "severity": "medium",
    "conditions": {"event_id": "4672", "message_regex": r"account name\s+user1"},
    "filters": {"exclude_users": ["USER10", "user11"]},
}
ANY_SYSMON = {
    "id": "any_sysmon",
    "name": "Any process event",
    "risk_level": "Düşük",
    "severity": "",
    "conditions": {"provider": "SYSMON"},
}
DISABLED = {"id": "off", "enabled": False, "severity": "critical", "conditions": {"threshold": 1}}
CHAIN = {
    "id": "chain",
    "name": "Document starts interpreter",
    "severity": "high",
    "conditions": {
        "provider": "Sysmon",
        "event_id": "1",
        "parent_image_regex": r"(?i)(winword\.exe|excel\.exe)",
        "image_regex": r"(?i)(powershell\.exe|cmd\.exe)",
        "time_window": 86400,
        "threshold": 2,
    },
}


def rules(*items: dict) -> list[Rule]:
    return [rule_from_dict(d, "queries.yaml", i) for i, d in enumerate(items)]


ALL_RULES = (DISABLED, ANY_SYSMON, COARSE, BRUTE_FORCE, FINE, PRIVILEGES, ENCODED)
SINGLE_RULES = (ANY_SYSMON, PRIVILEGES, ENCODED)


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return ev.prepare(A.raw_events(spark, d))


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return lookups.clean_feed(A.raw_feed(spark, d))


def _knowledge(spark: SparkSession, d: str) -> DataFrame:
    return lookups.merge_knowledge(
        lookups.local_knowledge(A.local_entries(spark, d)),
        lookups.external_knowledge(A.external_entries(spark, d), "row_no"),
    )


def _packets(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.flatten_packets(A.decoded_packets(spark, d))


def _open_ports(spark: SparkSession, d: str) -> DataFrame:
    catalogue = ports.port_catalogue(spark, A.services(spark, d))
    return ports.open_ports(A.connections(spark, d), catalogue, A.processes(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    answers = enrich.parse_answers(A.raw_answers(spark, d), None)
    return process.scored_events(
        A.raw_events(spark, d), rules(*ALL_RULES), _feed(spark, d), answers
    )


# --- sources ---------------------------------------------------------------------


@query
def s1_read_channel(spark, d):
    """Two channels written and read back, tagged by name."""
    out, raw = _run_dir(spark, "channels"), A.raw_events(spark, d)
    for name in ("Security", "Sysmon"):
        A.channel(raw, name).drop("log_source").withColumn("log_source", F.lit("?")).write.parquet(f"{out}/{name}")
    both = ev.merge_channels(*[ev.read_channel(spark, f"{out}/{name}", name) for name in ("Security", "Sysmon")])
    return both.groupBy("log_source", "event_id").agg(F.count(F.lit(1)).alias("events"))


@query
def s2_incremental_read(spark, d):
    """Events after a check time less five seconds, on both channels."""
    raw = A.raw_events(spark, d)
    merged = ev.merge_channels(A.channel(raw, "Security"), A.channel(raw, "Sysmon"))
    return ev.since(merged, "2024-01-20 00:00:00").select("record_id", "log_source", _us().alias("event_us"))


@query
def s3_merge_order(spark, d):
    """Latest arrival per hour in merged channel order."""
    raw = ev.in_time_order(A.raw_events(spark, d))
    hourly = raw.groupBy(F.date_trunc("hour", "event_time").alias("h")).agg(
        F.max("arrival").alias("last"), F.count(F.lit(1)).alias("events")
    )
    return hourly.select(
        _time("h").alias("hour"), F.col("last.log_source").alias("log_source"),
        F.col("last.record_id").alias("record_id"), "events",
    )


@query
def u1_channel_union(spark, d):
    raw = A.raw_events(spark, d)
    merged = ev.merge_channels(A.channel(raw, "Security"), A.channel(raw, "Sysmon"))
    return merged.groupBy("log_source", "event_id").agg(F.count(F.lit(1)).alias("events"))


@query
def s4_added_column(spark, d):
    """Rows written before a column existed, together with newer ones."""
    logs = A.security_logs(spark, d)
    old = logs.filter(F.col("id") % 2 == 0).drop("mitre_technique")
    both = store.conform(old).unionByName(store.conform(logs.filter(F.col("id") % 2 != 0)))
    return both.groupBy("mitre_technique").agg(F.count(F.lit(1)).alias("log_count"))


@query
def s5_rows_to_append(spark, d):
    """Rows as they are appended: time cut to seconds, id from the record."""
    raw = A.raw_events(spark, d).select(
        F.col("record_id").alias("id"), F.col("event_time").alias("timestamp"), "event_id", "message"
    )
    return store.to_stored(raw).select("id", _us("timestamp").alias("timestamp_us"), "event_id")


@query
def s6_scan_ordered(spark, d):
    return store.scan(A.security_logs(spark, d), 200, newest_first=False).select(
        "id", _time("timestamp").alias("timestamp"), "event_id", "risk_score_raw"
    )


@query
def s7_cleared_table(spark, d):
    """A table that is created, filled, cleared, and filled with every other row."""
    path, logs = _run_dir(spark, "logs"), A.security_logs(spark, d)
    store.create_table(spark, path)
    store.append(logs, path)
    store.clear(spark, path)
    store.append(logs.filter(F.col("id") % 2 == 0), path)
    kept = store.read_table(spark, path)
    return kept.select("id", _time("timestamp").alias("timestamp"), "event_id", "risk_score", "mitre_technique")


@query
def s13_archive_import(spark, d):
    """Rows as an archive file, whose messages have several lines, and read back."""
    path, logs = _run_dir(spark, "archive"), A.security_logs(spark, d)
    columns = ("id", "timestamp", "event_id", "message", "ai_analysis", "risk_score_raw")
    named = [F.col(c).cast("string").alias(h) for c, h in zip(columns, store.ARCHIVE_HEADER, strict=True)]
    writer = logs.select(*named).write.options(header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.option("escape", '"').csv(path)
    back = store.read_archive(spark, path)
    return back.select("id", _time("timestamp").alias("timestamp"), "event_id", F.md5("message").alias("message_md5"))


@query
def s8_threat_feed(spark, d):
    return _feed(spark, d)


@query
def s9_knowledge_list(spark, d):
    """Outside entries keyed by event id, last duplicate kept."""
    return lookups.external_knowledge(A.external_entries(spark, d), "row_no").groupBy(
        "risk_level"
    ).agg(F.count(F.lit(1)).alias("entries"))


@query
def s10_rule_catalogue(spark, d):
    """Rules loaded and enabled, and the events of each enabled rule's event id."""
    catalogue = rules_frame(spark, rules(*ALL_RULES)).filter("enabled")
    per_id = A.raw_events(spark, d).groupBy("event_id").agg(F.count(F.lit(1)).alias("events"))
    return (
        catalogue.select(F.col("id").alias("rule_id"), "severity", "event_id")
        .join(per_id, "event_id")
        .select("rule_id", "severity", "event_id", "events")
    )


@query
def s14_packets(spark, d):
    return _packets(spark, d).groupBy("protocol").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes")
    )


@query
def s15_connections(spark, d):
    return snapshots.listening(A.connections(spark, d)).groupBy("host").agg(
        F.count(F.lit(1)).alias("sockets"), F.count_distinct("port").alias("ports")
    )


# --- predicates ------------------------------------------------------------------


def _matched(spark, d, *items: dict) -> DataFrame:
    found = detect.all_matches(_prepared(spark, d), rules(*items))
    return found.select("record_id", "event_id", F.explode("detections").alias("m"))


@query
def f1_enabled_gate(spark, d):
    """Matches per rule; a disabled rule has none."""
    hits = _matched(spark, d, DISABLED, ANY_SYSMON, PRIVILEGES)
    return hits.groupBy(F.col("m.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("events"))


@query
def f2_provider(spark, d):
    return _matched(spark, d, {"id": "p", "conditions": {"provider": "sYsMoN"}}).select("record_id")


@query
def f3_event_id(spark, d):
    return _matched(spark, d, {"id": "e", "conditions": {"event_id": 4672}}).select("record_id")


@query
def f4_message_regex(spark, d):
    where = {"message_regex": r"^\s*source network ADDRESS:\s+1\d\.\d+\.[12]\.\d+$"}
    return _matched(spark, d, {"id": "m", "conditions": where}).select("record_id", "event_id")


@query
def f5_process_regex(spark, d):
    """Process tests pass where the event has no such field."""
    where = {
        "image_regex": r"\\(cmd|powershell|tool[01])\.EXE$",
        "command_line_regex": r"\bdir\b|\s-e\s",
        "parent_image_regex": "office",
    }
    return _matched(spark, d, {"id": "f", "conditions": where}).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("record_id").alias("id_sum")
    )


@query
def f6_user_filters(spark, d):
    users = {"exclude_users": ["system", "User3"], "include_users": ["USER1", "user3", "-", "Account"]}
    return _matched(spark, d, {"id": "u", "filters": users}).select("record_id")


@query
def f7_single_event_match(spark, d):
    hits = _matched(spark, d, *SINGLE_RULES)
    return hits.select("record_id", F.col("m.rule_id").alias("rule_id"))


@query
def f8_broken_pattern(spark, d):
    """A pattern that cannot be used never matches, and the other rules still run."""
    bad = {"id": "bad", "conditions": {"event_id": "4625", "message_regex": "(unclosed"}}
    hits = _matched(spark, d, bad, PRIVILEGES)
    return hits.groupBy(F.col("m.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("events"))


# --- rules against events --------------------------------------------------------


@query
def j1_first_match(spark, d):
    """First matching rule per event, threshold rules included."""
    out = detect.first_match(_prepared(spark, d), rules(*ALL_RULES))
    return out.select(
        "record_id",
        F.col("detection.rule_id").alias("rule_id"),
        F.col("detection.risk_level").alias("risk_level"),
        F.col("detection.mitre_technique").alias("mitre_technique"),
    )


@query
def j1_overlapping_reads(spark, d):
    """First match where every fifth record is read twice: it counts once, and all its rows agree."""
    events = ev.prepare(A.overlapping(A.raw_events(spark, d)))
    out = detect.first_match(events, rules(*ALL_RULES))
    return out.select("record_id", F.col("detection.rule_id").alias("rule_id"))


@query
def j1_two_hosts(spark, d):
    """First match over two hosts with the same record numbers."""
    events = ev.prepare(A.two_hosts(A.raw_events(spark, d)))
    out = detect.first_match(events, rules(BRUTE_FORCE, ENCODED, PRIVILEGES))
    return out.select("host", "record_id", F.col("detection.rule_id").alias("rule_id"))


@query
def j2_overlapping_reads(spark, d):
    """All matches where every fifth record is read twice."""
    events = ev.prepare(A.overlapping(A.raw_events(spark, d)))
    out = detect.all_matches(events, rules(*ALL_RULES))
    return out.select("record_id", _joined(F.transform("detections", lambda m: m["rule_id"])).alias("rule_ids"))


@query
def j2_all_matches(spark, d):
    """All matching rules per event, in load order."""
    out = detect.all_matches(_prepared(spark, d), rules(*ALL_RULES))
    ids = _joined(F.transform("detections", lambda m: m["rule_id"]))
    return out.select("record_id", ids.alias("rule_ids"))


def _large_catalogue() -> list[Rule]:
    """5,000 rules, each for one address in one kind of event; every tenth one counts."""
    out = []
    for k in range(5000):
        u, j = k // 4, k % 4
        address = rf"{1 + u % 223}\.{u % 256}\.{j}\.{1 + u % 250}"
        where = {"event_id": ("4625", "4624")[k % 7 % 2], "message_regex": rf"source network address:\s+{address}(\s|$)"}
        counted = {"threshold": 2, "time_window": 864000} if k % 10 == 3 else {}
        out.append({"id": f"r{k}", "severity": ("low", "high", "medium")[k % 3], "conditions": where | counted})
    return rules(*out)


@query
def j2_large_catalogue(spark, d):
    """All matches of 5,000 rules and those of the usual queries, by the index of required pieces."""
    found = detect.all_matches(_prepared(spark, d), rules(*ALL_RULES) + _large_catalogue())
    hits = found.select(F.explode("detections").alias("m"))
    return hits.groupBy(F.col("m.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("events"))


@query
def j1_large_catalogue(spark, d):
    """First match of the same rules without those that count."""
    chosen = [r for r in rules(*ALL_RULES) + _large_catalogue() if not r.counted]
    out = detect.first_match(_prepared(spark, d), chosen)
    return out.select("record_id", F.col("detection.rule_id").alias("rule_id"))


@query
def w1_threshold_alerts(spark, d):
    """Events at which the failed-logon rule fires."""
    return detect.threshold_alerts(_prepared(spark, d), rules(BRUTE_FORCE)).select(
        "record_id", _us().alias("event_us"), "threshold_key",
        F.col("detection.rule_id").alias("rule_id"),
    )


@query
def w1_threshold_ties(spark, d):
    """The same with times cut to four hours, so that many events share one time."""
    events = _prepared(spark, d)
    hours = F.floor(F.unix_micros("event_time") / 14_400_000_000) * 14_400_000_000
    coarse = events.withColumn("event_time", F.timestamp_micros(hours.cast("long")))
    return detect.threshold_alerts(coarse, rules(BRUTE_FORCE)).select(
        "record_id", _us().alias("event_us")
    )


@query
def w2_threshold_keys(spark, d):
    """Counting keys of a parent/child rule, and what fires per key."""
    out = detect.threshold_alerts(_prepared(spark, d), rules(CHAIN))
    return out.groupBy("threshold_key").agg(F.count(F.lit(1)).alias("fired"))


@query
def w3_rank_choice(spark, d):
    """Of all matching rules the one with the highest severity."""
    chosen = rules(*SINGLE_RULES)
    out = detect.pick_first(detect.all_matches(_prepared(spark, d), chosen), chosen)
    return out.select("record_id", F.col("detection.rule_id").alias("rule_id"))


# --- lookups ---------------------------------------------------------------------


@query
def j3_threat_hits(spark, d):
    """Events with a listed public address; the first one in the text counts."""
    out = enrich.threat_hits(enrich.with_ips(_prepared(spark, d)), _feed(spark, d))
    return out.filter(F.col("threat").isNotNull()).select("record_id", "threat.*")


#: Times from which the versions of the feed hold.
VERSIONS = ("2024-01-05 00:00:00", "2024-01-12 06:00:00", "2024-01-20 00:00:00")


@query
def j3_feed_versions(spark, d):
    """Events against the feed as it was at their time; each version drops a third of the entries and rates the others anew."""
    feed, parts = _feed(spark, d), []
    for k, at in enumerate(VERSIONS):
        rated = F.col("confidence") + F.when(F.col("confidence") % 2 == 0, k).otherwise(0)
        parts.append(feed.filter((F.col("confidence") + k) % 3 != 0).select("ip", "category", rated.alias("confidence"), F.lit(at).cast("timestamp").alias("version")))
    history = enrich.feed_history(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    out = enrich.threat_hits_at(enrich.with_ips(_prepared(spark, d)), history)
    return out.filter(F.col("threat").isNotNull()).select("record_id", "threat.*")


def _texts(spark, d) -> DataFrame:
    docs = A.table(spark, d, "documents").select(
        F.lit("documents").alias("log_source"), F.col("doc_id").alias("record_id"), "text"
    )
    pages = A.table(spark, d, "pages").select(
        F.lit("pages").alias("log_source"), F.col("page_id").alias("record_id"),
        F.col("html").alias("text"),
    )
    return docs.unionByName(pages)


@query
def x1_ips_of_documents(spark, d):
    """Addresses in free text: whole documents and pages."""
    found = enrich.with_ips(_texts(spark, d), "text").filter(F.size("ips") > 0)
    return found.select("log_source", "record_id", _joined("ips").alias("ips"), _joined("public_ips").alias("public_ips"))


@query
def j3_threat_hits_documents(spark, d):
    """Documents and pages that name a listed address; listed are those of every other document."""
    texts = enrich.with_ips(_texts(spark, d), "text")
    half = texts.filter((F.col("log_source") == "documents") & (F.col("record_id") % 2 == 0))
    feed = half.select(F.explode_outer("public_ips").alias("ip")).filter("ip is not null").distinct()
    feed = feed.withColumns({"category": F.lit("Named"), "confidence": F.length("ip") + 50})
    out = enrich.threat_hits(texts, feed).filter(F.col("threat").isNotNull())
    return out.select("log_source", "record_id", "threat.ip", "threat.confidence")


@query
def j4_knowledge(spark, d):
    """Knowledge of each event; own entries win."""
    events = A.raw_events(spark, d).select("record_id", "event_id")
    out = enrich.with_knowledge(events, _knowledge(spark, d))
    return out.select("record_id", "knowledge.title", "knowledge.risk_level", "knowledge.advice", "knowledge.source")


@query
def u3_knowledge_union(spark, d):
    return _knowledge(spark, d)


@query
def j5_port_catalogue(spark, d):
    catalogue = ports.port_catalogue(spark, A.services(spark, d))
    out = ports.with_port_info(snapshots.listening(A.connections(spark, d)), catalogue)
    return out.groupBy("port", "service", "risk", "description").agg(F.count(F.lit(1)).alias("sockets"))


@query
def j6_application(spark, d):
    out = ports.with_application(snapshots.listening(A.connections(spark, d)), A.processes(spark, d))
    return out.groupBy("application").agg(F.count(F.lit(1)).alias("sockets"))


@query
def j7_not_blocked(spark, d):
    events = enrich.with_ips(_prepared(spark, d))
    ips = events.select(F.explode_outer("public_ips").alias("ip")).filter("ip is not null")
    return respond.not_blocked(ips.distinct(), A.blocked(spark, d))


@query
def j8_packet_reputation(spark, d):
    """Packets from or to listed addresses and ranges."""
    feed = _feed(spark, d)
    ranges = feed.withColumn(
        "ip", F.when(F.col("confidence") % 10 == 0, F.concat("ip", F.lit("/24"))).otherwise(F.col("ip"))
    )
    out = traffic.reputation(_packets(spark, d), ranges)
    return out.groupBy("direction", "ip", "feed_entry", "category").agg(F.count(F.lit(1)).alias("packets"))


@query
def j8_range_feed(spark, d):
    """Packets against a feed of nested ranges of any size: ruled out by marked blocks, then compared."""
    feed = lookups.clean_feed(A.range_feed(spark, d))
    out = traffic.range_reputation(_packets(spark, d), feed, counted=True)
    return out.groupBy("direction", "ip", "feed_entry", "category", "confidence").agg(F.sum("packets").alias("packets"))


# --- aggregates ------------------------------------------------------------------


@query
def a1_total_logs(spark, d):
    return reports.total_count(A.security_logs(spark, d))


@query
def a2_high_risk_logs(spark, d):
    return reports.high_risk_count(A.security_logs(spark, d), "risk_score_raw")


@query
def a3_latest_detection(spark, d):
    return reports.latest_detection(A.security_logs(spark, d)).select(
        _time("latest_detection").alias("latest_detection")
    )


@query
def a4_timeline(spark, d):
    """15-minute buckets; every tenth time is unreadable and left out."""
    logs = A.security_logs(spark, d)
    shown = F.when(F.col("id") % 10 == 0, "not a time").otherwise(F.col("timestamp").cast("string"))
    return reports.timeline(logs.withColumn("timestamp", shown)).select(
        _time("time_interval").alias("time_interval"), "log_count"
    )


@query
def a5_risk_distribution(spark, d):
    return reports.risk_distribution(A.security_logs(spark, d), "risk_score_raw")


@query
def a6_traffic_counts(spark, d):
    return traffic.traffic_counts(_packets(spark, d)).select("dimension", "value", "packets")


@query
def a6_total_packets(spark, d):
    return traffic.total_packets(_packets(spark, d))


@query
def a7_active_ips(spark, d):
    return traffic.active_ips(traffic.traffic_counts(_packets(spark, d)))


@query
def a8_port_summary(spark, d):
    return ports.port_summary(_open_ports(spark, d))


@query
def a9_feed_size(spark, d):
    return lookups.feed_size(_feed(spark, d))


@query
def a11_capture_span(spark, d):
    return traffic.capture_span(_packets(spark, d))


@query
def a12_techniques(spark, d):
    return reports.technique_counts(A.security_logs(spark, d))


# --- order and limits ------------------------------------------------------------


@query
def w4_recent_packets(spark, d):
    return traffic.recent_packets(_packets(spark, d), 50).select(
        "seq", _time("ts").alias("ts"), "source_ip", "dest_ip", "protocol", "port", "length"
    )


@query
def k1_newest_logs(spark, d):
    return reports.newest(A.security_logs(spark, d)).select("id", _time("timestamp").alias("timestamp"), "event_id")


@query
def k1_newest_of_table(spark, d):
    """The newest rows of the stored table, from its last days."""
    path = _run_dir(spark, "newest")
    store.append(A.security_logs(spark, d), path)
    return store.read_newest(spark, path, reports.DASHBOARD_ROWS).select("id", _time("timestamp").alias("timestamp"), "event_id")


@query
def k2_top_talkers(spark, d):
    return traffic.top_talkers(traffic.traffic_counts(_packets(spark, d)))


@query
def u2_top_ip_union(spark, d):
    return traffic.top_ip_union(traffic.top_talkers(traffic.traffic_counts(_packets(spark, d))))


@query
def k3_high_risk_digest(spark, d):
    return reports.high_risk_digest(A.security_logs(spark, d)).select("id", "event_id", "risk_score_raw")


@query
def k4_ports_by_number(spark, d):
    return ports.by_port(_open_ports(spark, d)).select("host", "port", "pid", "application", "service", "risk")


@query
def k5_high_risk_ports(spark, d):
    return ports.high_risk_ports(_open_ports(spark, d)).select("port", "host", "pid", "service", "description")


# --- text, risk and packet columns -----------------------------------------------


@query
def x1_extract_ips(spark, d):
    out = enrich.with_ips(_prepared(spark, d))
    return out.select("record_id", _joined("ips").alias("ips"))


@query
def x2_valid_ipv4(spark, d):
    """Dotted numbers out of range or with leading zeros are no addresses."""
    n = F.col("l_partkey")
    ip = F.concat_ws(".", (n % 300).cast("string"), F.lpad((n % 30).cast("string"), 2, "0"),
                     (F.col("l_suppkey") % 280).cast("string"), F.col("l_linenumber").cast("string"))
    items = A.table(spark, d, "lineitem").select(ip.alias("ip"))
    return items.groupBy("ip").agg(F.count(F.lit(1)).alias("n")).withColumn("valid", ipf.is_valid_ipv4(F.col("ip")))


@query
def x3_private_ip(spark, d):
    """Addresses spread over the whole range and over the edges of the private ones."""
    edges = ("10.", "172.", "192.168.", "192.0.", "198.", "203.0.113.", "100.64.", "169.254.", "127.", "")
    n = F.col("l_partkey")
    head = A.pick(edges, F.col("l_orderkey") % 10)
    parts = F.concat_ws(".", *[(n % m).cast("string") for m in (256, 64, 20, 11)])
    ip = F.concat(head, F.array_join(F.slice(F.split(parts, r"\."), 1, 5 - F.size(F.split(head, r"\."))), "."))
    items = A.table(spark, d, "lineitem").select(ip.alias("ip"))
    return items.groupBy("ip").agg(F.count(F.lit(1)).alias("n")).withColumn("private", ipf.is_private_ip(F.col("ip")))


@query
def x4_user_name(spark, d):
    return _prepared(spark, d).select("record_id", text.user_from_message(F.col("message")).alias("user_name"))


@query
def x5_event_id_in_text(spark, d):
    found = text.event_id_from_text(F.col("context_text"))
    out = process.with_context(_prepared(spark, d))
    in_message = text.event_id_from_text(F.col("message"))
    return out.select("record_id", found.alias("found"), in_message.alias("in_message"))


@query
def x6_event_message(spark, d):
    return _prepared(spark, d).select("record_id", "message")


@query
def x7_process_created(spark, d):
    plain = A.raw_events(spark, d).drop("xml").filter("event_id = '1'")
    return ev.prepare(plain).select("record_id", "details.Image", "details.CommandLine", "details.User", "details.ParentImage")


@query
def x8_process_xml(spark, d):
    """Process fields with XML values on top; broken XML changes nothing."""
    return _prepared(spark, d).filter("details is not null").select(
        "record_id", "details.Image", "details.User", "details.ProcessId"
    )


@query
def x9_process_ended(spark, d):
    return _prepared(spark, d).filter("event_id = '5'").select("record_id", "details.Image", "details.ProcessId")


@query
def x10_context_text(spark, d):
    return process.with_context(_prepared(spark, d)).select("record_id", "context_text")


@query
def x11_shortened(spark, d):
    """Stored and digest lengths of whole documents; characters, not bytes."""
    docs = A.table(spark, d, "documents")
    cut = lambda n: F.left("text", F.lit(n))
    return docs.select("doc_id", F.md5(cut(500)).alias("stored"), F.length(cut(200)).alias("digest_chars"))


@query
def x12_severity_risk(spark, d):
    severity = A.pick(("critical", "high", "medium", "low", "info"), F.col("user_id") % 5)
    out = A.table(spark, d, "events").select(severity.alias("severity"), "event_type")
    return out.groupBy("severity", "event_type").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "risk", risk.severity_to_risk(F.col("severity"))
    ).withColumn("severity_rank", risk.severity_rank(F.col("severity")))


def _labels(spark, d) -> DataFrame:
    """The last word of each document, with a risk word chosen by the number of words before it."""
    odd = ("important", " HIGH ", "Following", "YÜKSEK risk", "orta", "Critical", "", "n/a", None, "düşük", "Medium-Low")
    docs = A.table(spark, d, "documents").withColumn("words", F.split("text", " "))
    label = F.concat(A.pick(odd, F.size("words") % 11), F.when(F.size("words") % 2 == 0, F.concat(F.lit(" "), F.element_at("words", -1))).otherwise(""))
    return docs.select("doc_id", label.alias("label"))


@query
def x13_answer_risk(spark, d):
    return _labels(spark, d).select("doc_id", risk.answer_risk(F.col("label")).alias("risk"))


@query
def x14_display_risk(spark, d):
    return _labels(spark, d).select("doc_id", risk.display_risk(F.col("label")).alias("risk"))


@query
def x15_risk_bucket(spark, d):
    return _labels(spark, d).select("doc_id", risk.risk_bucket(F.col("label")).alias("risk"))


@query
def x16_severity_label(spark, d):
    return _labels(spark, d).select("doc_id", risk.severity_label(F.col("label")).alias("severity"))


@query
def x18_external_knowledge(spark, d):
    return lookups.external_knowledge(A.external_entries(spark, d), "row_no")


@query
def x19_local_knowledge(spark, d):
    return lookups.local_knowledge(A.local_entries(spark, d))


@query
def x20_flatten_packets(spark, d):
    out = _packets(spark, d)
    return out.groupBy("source_ip", "dest_ip", "protocol", "port").agg(
        F.count(F.lit(1)).alias("packets"), F.min("seq").alias("first_seq")
    )


@query
def x21_packet_view(spark, d):
    shown = traffic.packet_view(_packets(spark, d))
    return shown.groupBy("time", "protocol", "port").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes")
    )


@query
def x22_port_text(spark, d):
    catalogue = ports.port_catalogue(spark, A.services(spark, d))
    used = A.connections(spark, d).select("port").distinct()
    return ports.with_port_info(used, catalogue)


@query
def x23_block_rule_name(spark, d):
    return A.blocked(spark, d).withColumn("rule_name", ipf.block_rule_name(F.col("ip")))


# --- log filters -----------------------------------------------------------------


@query
def q1_risk_filter(spark, d):
    return reports.filter_risk(A.security_logs(spark, d), ["High", "Low"]).select("id", "risk_score")


@query
def q2_event_id_filter(spark, d):
    return reports.filter_event_id(A.security_logs(spark, d), "46[27]").select("id", "event_id")


@query
def q3_text_search(spark, d):
    return reports.search(A.security_logs(spark, d), "  USER1[0-4]\\b|t1204 ").select("id")


@query
def q4_all_filters(spark, d):
    logs = A.security_logs(spark, d)
    return reports.filter_logs(logs, ["Medium", "High"], "4625", "user2").select("id", "event_id", "risk_score")


@query
def q5_log_view(spark, d):
    view = reports.log_view(A.security_logs(spark, d), "risk_score_raw")
    return view.select(_time("time").alias("time"), "event_id", "severity", "risk_level", "mitre_technique", "message")


@query
def s12_export_rows(spark, d):
    """Rows of an export: the filtered log table with its severity."""
    logs = reports.filter_logs(A.security_logs(spark, d), ["High"])
    return reports.with_severity(logs, "risk_score_raw").select("id", "risk_score_raw", "severity", "mitre_technique")


# --- fusion and response ---------------------------------------------------------


@query
def e1_risk_fusion(spark, d):
    return _scored(spark, d).select("record_id", "final_risk_raw", "final_risk")


@query
def e2_fused_text(spark, d):
    return _scored(spark, d).select("record_id", F.md5("final_analysis").alias("text_md5"))


@query
def e3_parse_answers(spark, d):
    answers = A.raw_answers(spark, d).withColumn("event_id", (F.col("record_id") % 100).cast("string"))
    return enrich.parse_answers(answers).select("record_id", "parsed", "analysis_risk")


@query
def e4_render_answers(spark, d):
    answers = A.raw_answers(spark, d).withColumn("event_id", (F.col("record_id") % 100).cast("string"))
    return enrich.parse_answers(answers).select("record_id", "analysis")


@query
def e5_prompts(spark, d):
    return process.prompt_rows(A.raw_events(spark, d), _knowledge(spark, d)).select(
        "record_id", "event_id", "system_prompt", "user_prompt"
    )


@query
def e6_block_list(spark, d):
    return respond.new_blocks(_scored(spark, d), A.blocked(spark, d)).select(
        "ip", "rule_name", _us("first_seen").alias("first_us"), "events"
    )


@query
def e7_unblock(spark, d):
    """Block list without the addresses the feed no longer lists as malicious."""
    blocked = A.blocked(spark, d)
    harmless = A.raw_feed(spark, d).select(text.strip(F.col("ip")).alias("ip"), "category").filter(
        F.lower(text.strip(F.col("category"))) == "benign"
    )
    return respond.unblock(blocked, harmless)


@query
def e8_system_digest(spark, d):
    return digest.system_digest(A.security_logs(spark, d), _open_ports(spark, d))


@query
def e9_process_events(spark, d):
    """Raw events to stored rows."""
    stored = process.stored_rows(_scored(spark, d))
    return stored.select(
        "id", _time("timestamp").alias("timestamp"), "event_id", "message",
        F.md5("ai_analysis").alias("analysis_md5"), "risk_score", "risk_score_raw", "mitre_technique",
    )


# --- streams ---------------------------------------------------------------------
# The given tables are read as streams until all available files are processed;
# the result is read back from the tables the stream wrote.


def _run_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _event_files(spark: SparkSession, d: str, out: str, parts: int = 4, again: bool = True) -> DataFrame:
    """The events as a stream of several parts, one per micro-batch and each of several files.

    The channel of processes lags behind: its events come one part later than
    the others of their time; with ``again`` the last part comes twice.
    """
    raw = A.raw_events(spark, d)
    us = F.unix_micros("event_time")
    low, high, rows = raw.agg(F.min(us), F.max(us), F.count(F.lit(1))).first()
    files = max(FILES, -(-rows // (parts * EVENT_ROWS)))
    place = F.floor((us - low) * parts / (high - low + 1)) + F.when(F.col("log_source") == "Sysmon", 1).otherwise(0)
    cut = cut_lineage(raw.withColumn("part", place.cast("int")))
    for part in [*range(parts + 1), *([parts] if again else [])]:
        one = cut.filter(F.col("part") == part).drop("part").repartition(files, "record_id")
        one.write.mode("append").parquet(f"{out}/files")
    return spark.readStream.schema(schemas.RAW_EVENT).option("maxFilesPerTrigger", files).parquet(f"{out}/files")


@query
def t1_polled_events(spark, d):
    """Events polled at intervals, not to the end of what is there, until nothing is left."""
    out = _run_dir(spark, "polled")
    job = jobs.distinct_stream(_event_files(spark, d, out, 2, again=False), out)
    try:
        job.processAllAvailable()
    finally:
        job.stop()
    return spark.read.parquet(f"{out}/events").groupBy("log_source", "event_id").agg(F.count(F.lit(1)).alias("events"))


@query
def t2_stream_dedupe(spark, d):
    """A record that is read twice counts once: several micro-batches, one channel lags, the last part comes twice."""
    out = _run_dir(spark, "distinct")
    jobs.distinct_stream(_event_files(spark, d, out), out, available_now=True, kept=timedelta(days=60)).awaitTermination()
    rows = spark.read.parquet(f"{out}/events")
    return rows.groupBy("log_source", "event_id").agg(F.count(F.lit(1)).alias("events"))


@query
def t3_stream_first_match(spark, d):
    """Detection over eight micro-batches: one channel lags, the last part repeats, a pattern is broken."""
    out = _run_dir(spark, "detect")
    bad = {"id": "bad", "severity": "critical", "conditions": {"event_id": "4625", "message_regex": "(unclosed"}}
    jobs.detect_stream(_event_files(spark, d, out, 6), lambda: rules(bad, *ALL_RULES), out, available_now=True).awaitTermination()
    return spark.read.parquet(f"{out}/detections").select(
        "record_id", F.col("detection.rule_id").alias("rule_id")
    )


@query
def t8_stream_blocks(spark, d):
    """Block list over eight micro-batches: half-way every other address is released, later events block some again.

    A fifth of the first half is read a second time after the release, and blocks nothing.
    """
    out = _run_dir(spark, "blocks")
    raw = A.raw_events(spark, d)
    us = F.unix_micros("event_time")
    low, high = raw.agg(F.min(us), F.max(us)).first()
    first = us < F.lit((low + high) // 2)
    feed = cut_lineage(_feed(spark, d))  # every micro-batch reads it

    def run(rows: DataFrame) -> None:
        rows.repartition(4, "record_id").write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(schemas.RAW_EVENT).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
        jobs.process_stream(
            stream, rules(*SINGLE_RULES), feed, out, available_now=True, kept=timedelta(days=60)
        ).awaitTermination()

    run(raw.filter(first))
    jobs.release(jobs.read_blocks(spark, out).filter(F.length("ip") % 2 == 0), out)
    run(raw.filter(~first | (F.col("record_id") % 5 == 0)))
    return jobs.read_blocks(spark, out).select("ip", "rule_name")


@query
def t4_stream_enrichment(spark, d):
    """Feed hit and knowledge of every event of the stream, also of events with several addresses."""
    out = _run_dir(spark, "enrich")
    stream = A.as_raw_events(A.stream_table(spark, d, "events"))
    jobs.enrich_stream(stream, _feed(spark, d), _knowledge(spark, d), out, available_now=True).awaitTermination()
    rich = spark.read.parquet(f"{out}/enriched")
    return rich.select("record_id", "threat.ip", "threat.category", F.col("knowledge.source").alias("knowledge_source"))


@query
def t5_stream_counters(spark, d):
    """Packet counters over several micro-batches, merged on the way."""
    out = _run_dir(spark, "traffic")
    packets = A.table(spark, d, "lineitem")
    files = -(-packets.count() // (5 * FILE_ROWS)) or 1
    packets.repartition(5 * files, "l_orderkey", "l_linenumber").write.parquet(f"{out}/files")
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", files).parquet(f"{out}/files")
    decoded = snapshots.flatten_packets(A.as_decoded_packets(stream))
    jobs.count_stream(decoded, out, available_now=True, merge_every=2).awaitTermination()
    return traffic.top_talkers(jobs.read_counters(spark, out))


@query
def e9_rescored(spark, d):
    """Events that wait for their answers: a third of these comes before the events, a third with them, a third later.

    The rest of the events is finished without one.
    """
    out = _run_dir(spark, "rescored")
    parsed = cut_lineage(enrich.parse_answers(A.raw_answers(spark, d), None))

    def answer(part: int) -> None:
        parsed.filter(F.pmod("record_id", F.lit(3)) == part).repartition(2, "record_id").write.mode("append").parquet(f"{out}/answers")
        answers = spark.readStream.schema(parsed.schema).parquet(f"{out}/answers")
        jobs.answer_stream(answers, out, available_now=True).awaitTermination()

    answer(0)
    jobs.process_stream(
        _event_files(spark, d, out, 2, again=False), rules(*ALL_RULES), cut_lineage(_feed(spark, d)), out, available_now=True, wait=True
    ).awaitTermination()
    answer(1)
    answer(2)
    jobs.expire_pending(spark, out, "expired")
    stored = store.read_table(spark, f"{out}/logs")
    return stored.select("id", F.md5("ai_analysis").alias("analysis_md5"), "risk_score", "risk_score_raw")


@query
def t6_running_rollups(spark, d):
    """Counts of the reports, kept by what each micro-batch stores: answered events, then those without an answer."""
    out = _run_dir(spark, "rollups")
    jobs.process_stream(
        _event_files(spark, d, out, 2, again=False), rules(*SINGLE_RULES), cut_lineage(_feed(spark, d)), out, available_now=True, wait=True
    ).awaitTermination()
    parsed = enrich.parse_answers(A.raw_answers(spark, d), None)
    parsed.write.parquet(f"{out}/answers")
    answers = spark.readStream.schema(parsed.schema).parquet(f"{out}/answers")
    jobs.answer_stream(answers, out, available_now=True, rollups=True).awaitTermination()
    jobs.expire_pending(spark, out, "expired", rollups=True)
    return jobs.read_rollups(spark, out)


@query
def t9_stream_timeline(spark, d):
    """15-minute counts of the event stream."""
    out = _run_dir(spark, "timeline")
    stream = A.as_raw_events(A.stream_table(spark, d, "events"))
    counts = jobs.timeline_stream(stream.select(F.col("event_time").alias("timestamp")))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    counts.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(
        availableNow=True
    ).foreachBatch(keep).start().awaitTermination()
    latest = spark.read.parquet(f"{out}/rows").groupBy("time_interval").agg(
        F.max_by("log_count", "batch").alias("log_count")
    )
    return latest.select(_time("time_interval").alias("time_interval"), "log_count")
