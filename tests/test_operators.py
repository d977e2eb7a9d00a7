import datetime as dt
import json

from pyspark.sql import functions as F

from wardlake import schemas
from wardlake.operators import enrich, ports, reports, respond, traffic
from wardlake.operators.rules import load_rules, rule_from_dict
from wardlake.operators.sizes import broadcast_if_small, is_small
from wardlake.plans import digest, process
from wardlake.sources import snapshots

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def feed_of(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.THREAT_FEED)


def texts(spark, *values):
    df = spark.createDataFrame([(i, "S", v) for i, v in enumerate(values)], "record_id long, log_source string, combined_text string")
    return enrich.with_ips(df)


def test_first_listed_address_counts(spark):
    events = texts(spark, "10.0.0.1 5.6.7.8 1.2.3.4", "1.2.3.4 5.6.7.8 1.2.3.4", "9.9.9.9", "none", "10.0.0.1")
    feed = feed_of(spark, ("1.2.3.4", "Botnet", 100), ("5.6.7.8", "Brute", 90), ("10.0.0.1", "Inside", 80))
    want = {0: "5.6.7.8", 1: "1.2.3.4", 2: None, 3: None, 4: None}
    doubled = feed.unionByName(feed_of(spark, ("1.2.3.4", "Botnet", 100), ("1.2.3.4", "Older", 60)))
    nameless = events.withColumn("log_source", F.lit(None).cast("string"))
    for rows, entries in ((events, feed), (events, doubled), (nameless, feed)):
        out = enrich.threat_hits(rows, entries)
        assert {r[0]: r[1] for r in out.select("record_id", "threat.ip").collect()} == want
        assert out.count() == 5 and out.filter("threat.category = 'Older'").count() == 0
    empty = enrich.threat_hits(events, feed_of(spark))
    assert empty.filter("threat is not null").count() == 0


def answer(**kw):
    return dict(risk_score="High", user_entity="u", summary="s", advice="a") | kw


def test_answers(spark):
    good = json.dumps(answer())
    raws = [
        good, f"text ```json\n{good}\n``` end", f"```\n{good}\n```", json.dumps(answer(event_id_explanation="why")),
        json.dumps(answer(event_id_explanation=None)), json.dumps({"risk_score": "High"}), good[:-1], "[1]", "",
        json.dumps(answer(risk_score=5)), json.dumps(answer(risk_score="")), json.dumps(answer(event_id_explanation=3)), None,
    ]
    df = spark.createDataFrame([(i, r, "7") for i, r in enumerate(raws)], "record_id long, raw_response string, event_id string")
    rows = {r.record_id: r for r in enrich.parse_answers(df).collect()}
    assert [rows[i].parsed for i in range(13)] == [True] * 5 + [False] * 5 + [True, False, False]
    body = "🕵️‍♂️ Analysis\nUser/Entity: u\nSummary: s\nRisk Level: Yüksek\n\n💡 Recommendation\na"
    assert [rows[i].analysis for i in (0, 1, 2, 4)] == [body] * 4
    assert rows[3].analysis == "🆔 Event ID Explained\nwhy\n\n" + body
    assert (rows[0].analysis_risk, rows[5].analysis_risk, rows[10].analysis_risk) == ("Yüksek", "Medium", "Orta")
    assert "This Event ID (7) is an event" in rows[7].analysis and "Summary: [1]" in rows[7].analysis


def raw(spark, *rows):
    data = [(None, i, s, e, T0 + dt.timedelta(seconds=i, microseconds=5), m, None, None) for i, (s, e, m) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.RAW_EVENT)


def test_whole_job(spark):
    raw_events = raw(
        spark,
        ("Security", "4624", "from 1.2.3.4 and 10.0.0.1"),
        ("Security", "4672", "from 8.8.8.8"),
        ("Security", "4634", "x" * 600 + " 9.9.9.9"),
        ("Security", "4634", "quiet 7.7.7.7"),
    )
    rules = [
        rule_from_dict({"id": "h", "severity": "high", "mitre": ["T1", "T2"], "match_message": "hit", "conditions": {"event_id": 4672}}),
        rule_from_dict({"id": "l", "severity": "low", "mitre": "T9", "match_message": "low", "conditions": {"event_id": 4624}}),
    ]
    feed = feed_of(spark, ("1.2.3.4", "Botnet", 100))
    day = dt.timedelta(days=1)
    parsed = [
        (None, "Security", 2, "text", "Yüksek", None, T0), (None, "Security", 3, "old", "High", None, T0 - day),
        (None, "Security", 3, "text", "Düşük", None, T0), (None, "Sysmon", 0, "other channel", "High", None, T0),
        (None, "Security", 1, None, "Medium", "broken", T0),
    ]
    answers = spark.createDataFrame(parsed, "host string, log_source string, record_id long, analysis string, analysis_risk string, reason string, answered_at timestamp")
    blocked = spark.createDataFrame([("8.8.8.8", "r", T0, 1)], schemas.BLOCK_LIST)
    stored, blocks = process.process_events(raw_events, rules, feed, answers, blocked)
    rows = {r.id: r for r in stored.collect()}
    assert [rows[i].risk_score for i in range(4)] == ["High", "High", "High", "Low"]
    assert [rows[i].risk_score_raw for i in range(4)] == ["High", "High", "Yüksek", "Düşük"]
    assert [rows[i].mitre_technique for i in range(4)] == ["T9", "T1", None, None]
    notice = "🛡️ [ACTION TAKEN]: IP adres(ler)i engellendi: "
    header = "🚨 [THREAT INTEL MATCH] IP 1.2.3.4 zararlı listede bulundu! Kategori: Botnet, Güven: 100%\n\n"
    assert rows[0].ai_analysis.startswith(notice + "1.2.3.4\n\n" + header) and "low" not in rows[0].ai_analysis
    assert rows[1].ai_analysis.startswith(notice + "8.8.8.8\n\nhit\n\n---\n\n🆔") and "(4672)" in rows[1].ai_analysis and "broken" in rows[1].ai_analysis
    assert stored.count() == 4 and "other channel" not in rows[0].ai_analysis
    assert rows[2].ai_analysis == notice + "9.9.9.9\n\ntext" and len(rows[2].message) == 500
    assert rows[3].ai_analysis == "text" and rows[0].timestamp == T0
    # Addresses come from the whole text; what is blocked already is not added again.
    assert {(r.ip, r.events) for r in blocks.collect()} == {("1.2.3.4", 1), ("9.9.9.9", 1)}
    left = respond.unblock(blocked, spark.createDataFrame([("8.8.8.8",), ("8.8.8.8",)], "ip string"))
    assert left.count() == 0
    asked = spark.createDataFrame([("4.4.4.4", T0), ("10.0.0.1", T0), ("x", T0), ("8.8.8.8", T0)], "ip string, event_time timestamp")
    assert [r.ip for r in respond.manual_blocks(asked, blocked).collect()] == ["4.4.4.4"]


def test_event_without_inserts_is_stored_with_fallback(spark):
    stored, _ = process.process_events(raw(spark, ("Security", "1", None)), load_rules(), feed_of(spark), None, respond.empty_block_list(spark))
    row = stored.first()
    assert row.message == "Message could not be retrieved" and row.risk_score == "Medium"


def logs(spark, *rows):
    data = [(None, None, i, T0 + dt.timedelta(minutes=m), e, msg, a, r, r, t) for i, (m, e, msg, a, r, t) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.STORED_LOG)


def test_reports(spark):
    table = logs(
        spark,
        (0, "4625", "Logon Failed", None, "High", "T1, T2"),
        (14, "4625", None, "Nothing", "Yüksek", "T1"),
        (15, "1", "ok", "SEARCH me", "Low", None),
        (31, "14625", "ok", "x", None, ""),
        (32, "2", "ok", "x", "Critical", "T2"),
    )
    m = reports.metrics(table).first()
    assert (m.total_logs, m.high_risk_logs, m.latest_detection) == (5, 2, T0 + dt.timedelta(minutes=32))
    assert reports.latest_detection(table.limit(0)).first()[0] is None
    bins = {r.time_interval: r.log_count for r in reports.timeline(table).collect()}
    assert bins == {T0: 2, T0 + dt.timedelta(minutes=15): 1, T0 + dt.timedelta(minutes=30): 2}
    assert {tuple(r) for r in reports.risk_distribution(table).collect()} == {("High", 2), ("Low", 1), ("Unspecified", 2)}
    assert {tuple(r) for r in reports.technique_counts(table).collect()} == {("T1", 2), ("T2", 2)}
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(reports.filter_risk(table, ["high", "LOW"])) == [0, 1, 2]
    assert ids(reports.filter_event_id(table, "^4625")) == [0, 1]
    assert ids(reports.search(table, " FAILED ")) == [0] and ids(reports.search(table, "search|t2")) == [0, 2, 4]
    assert ids(reports.search(table, "none")) == [] and ids(reports.search(table, "  ")) == [0, 1, 2, 3, 4]
    assert ids(reports.filter_logs(table, ["High"], "46", "failed")) == [0]
    assert ids(reports.newest(table, 2)) == [3, 4]
    view = {r.time: (r.severity, r.risk_level) for r in reports.log_view(table).collect()}
    assert view[T0] == ("Critical", "High") and view[T0 + dt.timedelta(minutes=31)] == ("Unspecified", "Unspecified")


def test_digest_limits_before_it_filters(spark):
    rows = [(m, str(m), "m", "a", "High" if m < 5 else "Low", None) for m in range(60)]
    rows += [(100 + m, "new", "m", "a", " High ", None) for m in range(3)]
    got = reports.high_risk_digest(logs(spark, *rows))
    assert sorted(r.id for r in got.collect()) == [60, 61, 62]


def packets(spark, *rows):
    data = [(i, T0 + dt.timedelta(milliseconds=ms), s, d, p, port, 10, "x") for i, (ms, s, d, p, port) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.PACKET)


def test_traffic(spark):
    table = packets(
        spark,
        (0, "b", "x", "TCP", 80), (1, "a", "y", "TCP", 0), (2, "a", None, "0", None), (3, "b", "", None, 443),
        *[(10 + i, f"s{i:02}", "x", "UDP", 53) for i in range(12)],
    )
    counts = traffic.traffic_counts(table)
    got = {(r.dimension, r.value): r.packets for r in counts.collect()}
    assert got[("source_ip", "a")] == 2 and got[("port", "53")] == 12
    assert ("port", "0") not in got and ("protocol", "0") not in got and ("dest_ip", "") not in got
    top = [r.value for r in traffic.top_talkers(counts).filter("dimension = 'source_ip'").orderBy("place").collect()]
    assert top == ["b", "a"] + [f"s{i:02}" for i in range(8)]
    active = traffic.active_ips(counts).first()
    assert (active.active_ips, active.active_ips_exact) == (12, 16)
    assert traffic.total_packets(table).first()[0] == 16
    assert abs(traffic.capture_span(table).first()[0] - 0.021) < 1e-9
    recent = traffic.packet_view(traffic.recent_packets(table, 14)).collect()
    assert (recent[0].time, recent[0].dest_ip, recent[0].protocol, recent[0].port) == ("2024-01-01 10:00:00.002", "N/A", "Unknown", "N/A")


def test_reputation_with_ranges(spark, monkeypatch):
    table = packets(spark, (0, "1.2.3.4", "9.9.9.9", "TCP", 1), (1, "20.1.77.3", "1.2.3.4", "TCP", 1), (2, "aa:bb", None, "Ethernet", None))
    feed = feed_of(spark, ("1.2.3.4", "Bot", 90), ("20.1.0.0/16", "Net", 50), ("9.9.9.9/33", "bad", 1), ("zz", "bad", 1))
    want = {(0, "source", "1.2.3.4"), (1, "source", "20.1.0.0/16"), (1, "destination", "1.2.3.4")}
    for bound in (traffic.BROADCAST_ROWS, 0):
        monkeypatch.setattr(traffic, "BROADCAST_ROWS", bound)
        got = {(r.seq, r.direction, r.feed_entry) for r in traffic.reputation(table, feed).collect()}
        assert got == want


def test_ranges_of_any_size(spark):
    """Every length, nested, at block edges; against the definition."""
    import ipaddress
    import random

    rng = random.Random(6)
    base = [rng.getrandbits(32) for _ in range(6)]
    nets = {ipaddress.ip_network((b, bits), strict=False) for b in base for bits in range(0, 33)}
    nets |= {ipaddress.ip_network("10.0.0.0/9"), ipaddress.ip_network("255.255.255.255/32"), ipaddress.ip_network("0.0.0.0/25")}
    names = [str(n) if n.prefixlen < 32 else str(n[0]) for n in nets if n.prefixlen or rng.random() < 2]
    near = [b ^ rng.getrandbits(rng.randrange(33)) for b in base for _ in range(30)]
    ips = [str(ipaddress.ip_address(n)) for n in [*near, 0, 127, 128, 2**32 - 1]]
    table = packets(spark, *[(i, ip, "aa:bb" if i % 7 else None, "TCP", 1) for i, ip in enumerate(ips)])
    for chosen in (names, [n for n in names if int((n + "/32").split("/")[1]) >= 24], [n for n in names if "/" in n and int(n.split("/")[1]) < 24]):
        got = sorted((r.seq, r.feed_entry) for r in traffic.range_reputation(table, feed_of(spark, *[(n, "c", 1) for n in chosen])).collect())
        assert got == sorted((i, n) for i, ip in enumerate(ips) for n in chosen if ipaddress.ip_address(ip) in ipaddress.ip_network(n))


def test_ranges_meet_addresses_that_are_counted_first(spark):
    """Many packets of one address meet nested ranges as one row; the numbers are those of the packets."""
    ips = ["1.2.3.4"] * 300 + ["1.2.3.200", "9.9.9.9", "aa:bb", None]
    table = packets(spark, *[(i, ip, "1.2.3.4" if i % 100 == 0 else None, "TCP", 1) for i, ip in enumerate(ips)])
    nets = ["1.0.0.0/8", "1.2.0.0/14", "1.2.0.0/16", "1.2.3.0/24", "1.2.3.0/25", "1.2.3.4", "8.0.0.0/8"]
    feed = feed_of(spark, *[(n, "c", 1) for n in nets]).unionByName(feed_of(spark, ("1.2.3.4", "c", 1)))  # one row twice
    counted = traffic.range_reputation(table, feed, counted=True)
    assert counted.count() == 7 + 7 + 4
    names = ("direction", "ip", "feed_entry", "category", "confidence")
    each = traffic.range_reputation(table, feed).groupBy(*names).count()
    got = counted.groupBy(*names).agg({"packets": "sum"})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, each.collect()))
    assert ("source", "1.2.3.4", "1.2.3.4", "c", 1, 600) in set(map(tuple, got.collect()))


def test_packets_stay_in_place_until_their_block_is_marked(spark):
    blocks = spark.range(0, 2**24, 1000).withColumnRenamed("id", "block")
    marks = traffic.block_marks(blocks)
    assert marks.count() <= 512 and marks.agg({"_marks": "max"}).first() and marks.selectExpr("max(length(_marks)) n").first().n == 4096
    plan = traffic.range_reputation(packets(spark, (0, "1.2.3.4", None, "TCP", 1)), feed_of(spark, ("1.2.3.0/25", "c", 1)))._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in plan


def test_broadcast_only_below_the_bound(spark):
    table = spark.range(10).repartition(2)
    assert is_small(table, 10) and not is_small(table, 9)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in plan(broadcast_if_small(table, 10))
    assert "strategy=broadcast" not in plan(broadcast_if_small(table, 9))


def test_ports(spark):
    rows = [("h", T0, "tcp", "LISTEN", 3389, 1), ("h", T0, "tcp", "LISTEN", 80, None), ("h", T0, "tcp", "LISTEN", 631, 9),
            ("h", T0, "tcp", "LISTEN", 50000, 1), ("h", T0, "udp", "LISTEN", 21, 1), ("h", T0, "tcp", "ESTABLISHED", 21, 1)]
    conns = spark.createDataFrame(rows, schemas.CONNECTION)
    procs = spark.createDataFrame([("h", 1, "before", T0), ("h", 1, "svc", T0 + dt.timedelta(1)), ("other", 9, "no", T0)], schemas.PROCESS)
    services = spark.createDataFrame([(631, "ipp"), (80, "www")], "port int, service string")
    found = ports.open_ports(conns, ports.port_catalogue(spark, services), procs)
    got = {r.port: (r.application, r.service, r.risk, r.description) for r in found.collect()}
    assert got == {
        3389: ("svc", "RDP", "High", "RDP service - Should be carefully monitored from security perspective"),
        80: ("Unknown", "HTTP", "Low", "HTTP service - Generally safe"),
        631: ("Access Denied", "IPP", "Low", "IPP service"),
        50000: ("svc", "Unknown", "Low", "Unknown service"),
    }
    assert [r.port for r in ports.by_port(found).collect()] == [80, 631, 3389, 50000]
    assert tuple(ports.port_summary(found).first()) == (4, 1, 3)
    assert [r.port for r in ports.high_risk_ports(found).collect()] == [3389]
    assert snapshots.listening(conns).count() == 4


def test_system_digest(spark):
    table = logs(spark, (0, "4625", "m" * 300, None, "Yüksek", None), (1, "1", None, "a", "Low", None))
    conns = spark.createDataFrame([("h", T0, "tcp", "LISTEN", 80, None)], schemas.CONNECTION)
    found = ports.open_ports(conns, ports.port_catalogue(spark), spark.createDataFrame([], schemas.PROCESS))
    rows = [tuple(r) for r in digest.system_digest(table, found).orderBy("section", "line_no").collect()]
    assert rows[1] == (1, 1, "- Event ID 4625 (Time: 2024-01-01 10:00:00)\n  Message: " + "m" * 200 + "\n  AI Analysis: No analysis\n  Risk: Yüksek\n")
    assert rows[2:] == [(2, 0, "=== OPEN PORTS ==="), (2, 1, "No high-risk open ports found."), (3, 0, "Total Open Ports: 1\nHigh Risk: 0\nLow Risk: 1\n")]
    none = digest.system_digest(table.filter("id = 1"), found.limit(0)).orderBy("section", "line_no").collect()
    assert [r.text for r in none][:2] == ["=== HIGH RISK LOGS ===", "No high-risk logs found."] and len(none) == 4


def test_prompts_bind_known_advice(spark):
    kb = spark.createDataFrame([("7", "t", "d", "Orta", "do it", "local")], schemas.KNOWLEDGE)
    events = spark.createDataFrame([(1, "Event ID: 7 x"), (2, "Event ID: 8"), (3, "none")], "record_id long, context_text string").withColumn("log_source", F.lit("S"))
    rows = {r.record_id: r for r in enrich.prompts(events, kb, "BASE").collect()}
    assert '"do it"' in rows[1].system_prompt and '"Orta"' in rows[1].system_prompt
    assert rows[2].system_prompt == rows[3].system_prompt == "BASE" and rows[3].event_id is None
    assert rows[1].user_prompt.endswith("\n\nEvent ID: 7 x")
    note = enrich.with_knowledge(events.withColumn("event_id", F.lit(" 7 ")), kb).select(enrich.knowledge_note(F.lit("7"), F.col("knowledge"))).first()[0]
    assert note == "Known facts about event 7\nTitle: t\nDescription: d\nRisk: Orta\nAdvice: do it"


def test_feed_versions(spark):
    """Entries that stay, change, go and come back; events at the edges of versions."""
    from wardlake.operators import enrich

    at = lambda h: T0 + dt.timedelta(hours=h)
    rows = [(0, "1.1.1.1", "Bot", 50), (10, "1.1.1.1", "Bot", 50), (20, "1.1.1.1", "Scan", 50), (0, "2.2.2.2", "Bot", 9), (20, "2.2.2.2", "Bot", 9), (10, "3.3.3.3", "x", 1)]
    versions = spark.createDataFrame([(at(h), *r) for h, *r in rows], "version timestamp, ip string, category string, confidence int")
    history = enrich.feed_history(versions)
    got = {(r.ip, r.category, r.valid_from, r.valid_to) for r in history.collect()}
    assert got == {("1.1.1.1", "Bot", at(0), at(20)), ("1.1.1.1", "Scan", at(20), None), ("2.2.2.2", "Bot", at(0), at(10)),
                   ("2.2.2.2", "Bot", at(20), None), ("3.3.3.3", "x", at(10), at(20))}
    times = [-1, 0, 9, 10, 19, 20, 99, None]
    data = [(i, "S", None if h is None else at(h), ["9.9.9.9", "2.2.2.2", "1.1.1.1", "2.2.2.2"]) for i, h in enumerate(times)]
    events = spark.createDataFrame(data, "record_id long, log_source string, event_time timestamp, public_ips array<string>")
    hits = {r.record_id: r.threat and (r.threat.ip, r.threat.category) for r in enrich.threat_hits_at(events, history).collect()}
    two, one = ("2.2.2.2", "Bot"), ("1.1.1.1", "Bot")
    assert hits == {0: None, 1: two, 2: two, 3: one, 4: one, 5: two, 6: two, 7: None}


def test_size_of_texts_inside_structs(spark):
    from wardlake.operators.sizes import is_small

    wide = spark.range(10).selectExpr("struct(repeat('x', 1000) AS a, id AS b) AS s", "array('abc') AS l", "id")
    assert is_small(wide, 10, 10_200) and not is_small(wide, 10, 10_000) and is_small(spark.range(5), 5, 0)
