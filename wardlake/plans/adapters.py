"""The given tables seen as security events, logs, packets, ports and lookups.

Plain arithmetic on the columns, one row out per row in (or a filter of them),
so the derived tables grow with the given ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlake import schemas
from wardlake.functions.risk import canonical_risk
from wardlake.functions.text import event_message

EVENT_IDS = {"error": "4625", "click": "4624", "view": "4634", "purchase": "4672"}
IMAGES = (r"C:\Windows\cmd.exe", r"C:\Windows\powershell.exe", r"C:\Apps\notepad.exe", r"C:\Apps\chrome.exe")
COMMANDS = ("cmd /c dir", "powershell -EncodedCommand SQBFAFgA", "notepad a.txt", "powershell -e QUJD", "chrome")
PARENTS = (r"C:\Office\WINWORD.EXE", r"C:\Windows\explorer.exe", r"C:\Office\EXCEL.EXE")
RISK_LABELS = ("High", "Yüksek", "Medium", "Düşük", None, "Low risk", "Critical", "unknown")
TECHNIQUES = (None, "T1110", "T1059.001, T1204.002, T1027", "T1078")
PACKET_PORTS = (443, 80, 22, 3389, 445, 0, 8080, 53)
LISTEN_PORTS = (21, 23, 445, 3389, 80, 443, 22, 5353, 8080, 40001, 40002, 631)
ANSWER_LABELS = ("Low", "Medium", "High", "Yüksek", "Orta", "Düşük", "highly", "", "important")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    """The value at a zero-based position of a short fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def ip_of(u: Column, j: Column) -> Column:
    return _text(1 + u % 223, ".", u % 256, ".", j, ".", 1 + u % 250)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream."""
    schema = table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(sf_dir)


def _events(e: DataFrame) -> DataFrame:
    """``events`` with its own columns and the raw event columns beside them."""
    rid, uid, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    user = F.when(rid % 7 == 0, "SYSTEM").when(rid % 7 == 1, "-").otherwise(_text("user", uid % 40))
    ip = ip_of(uid, rid % 4)
    sysmon = kind == "signup"
    code = F.when(sysmon & (uid % 10 == 9), "5").when(sysmon, "1")
    for name, number in EVENT_IDS.items():
        code = code.when(kind == name, number)
    message = (
        F.when(rid % 97 == 0, F.lit(None).cast("string"))
        .when(sysmon, " ")
        .when(
            kind == "error",
            _text("An account failed to log on.\n\nSubject:\n\tAccount Name:\t\t", user,
                  "\n\nNetwork Information:\n\tSource Network Address:\t", ip, "\n\tSource Port:\t0"),
        )
        .when(
            kind == "click",
            _text("An account was successfully logged on.\n\nUser Name:\t", user,
                  "\nSource Network Address:\t", ip, "\n"),
        )
        .when(kind == "view", _text("An account was logged off. User ", user, " Event ID: 4634"))
        .otherwise(_text("Special privileges assigned. Account Name ", user))
    )
    rule_name = F.when(rid % 4 == 0, "").otherwise("-")
    filler = [F.lit("x")] * 20
    created = list(filler)
    created[0], created[3] = rule_name, uid.cast("string")
    created[4], created[10] = pick(IMAGES, uid % 4), pick(COMMANDS, uid % 5)
    created[12], created[19] = user, pick(PARENTS, rid % 3)
    inserts = F.when(sysmon, F.array(*created)).when(rid % 3 == 0, F.array(user, F.lit(""), ip))
    xml = F.when(
        sysmon & (rid % 5 == 0),
        _text('<Event><EventData><Data Name="Image">C:\\xml\\tool', uid % 3,
              '.exe</Data><Data Name="User">', user, "</Data></EventData></Event>"),
    ).when(rid % 5 == 1, "<broken")
    return e.select(
        F.lit(None).cast("string").alias("host"),
        rid.alias("record_id"),
        "user_id",
        "event_type",
        "value",
        F.when(sysmon, "Sysmon").otherwise("Security").alias("log_source"),
        code.alias("event_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        message.alias("message"),
        inserts.alias("inserts"),
        xml.alias("xml"),
    )


def as_raw_events(events: DataFrame) -> DataFrame:
    return _events(events).select(*schemas.RAW_EVENT.fieldNames())


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw event records of two channels."""
    return as_raw_events(table(spark, sf_dir, "events"))


def channel(events: DataFrame, log_source: str) -> DataFrame:
    return events.filter(F.col("log_source") == log_source)


def security_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as rows of the stored log table."""
    label = pick(RISK_LABELS, F.floor("value") % 8)
    return _events(table(spark, sf_dir, "events")).select(
        F.col("record_id").alias("id"),
        F.date_trunc("second", "event_time").alias("timestamp"),
        "event_id",
        F.left(event_message(F.col("message"), F.col("inserts")), F.lit(500)).alias("message"),
        F.when(
            F.col("user_id") % 3 != 0,
            _text("Summary: ", F.col("event_type"), " by User", F.col("user_id")),
        ).alias("ai_analysis"),
        canonical_risk(label).alias("risk_score"),
        label.alias("risk_score_raw"),
        pick(TECHNIQUES, F.col("user_id") % 4).alias("mitre_technique"),
    )


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as lines of a threat feed, with padding, duplicates and bad rows."""
    k = F.col("c_custkey")
    ip = ip_of(k % 200, F.floor(k / 200) % 5)
    return table(spark, sf_dir, "customer").select(
        F.when(k % 13 == 5, "  ").when(k % 6 == 0, _text(" ", ip, " ")).otherwise(ip).alias("ip"),
        pick(("Botnet", " BruteForce ", "Benign", "Malware", "benign "), k % 5).alias("category"),
        F.when(k % 7 == 0, "0").when(k % 11 == 3, "n/a").otherwise((50 + k % 50).cast("string"))
        .alias("confidence"),
        k.alias("row_no"),
    )


def local_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation`` as own knowledge entries."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.when(n == 0, "4672").when(n == 1, "1").otherwise((4620 + n).cast("string")).alias("event_id"),
        _text("Own ", F.col("n_name")).alias("title"),
        F.col("n_name").alias("description"),
        F.when(n % 3 != 0, pick(("Düşük", "Orta", "Yüksek"), n % 3)).alias("risk_level"),
        F.when(n % 4 != 0, _text("Check ", F.col("n_name"))).alias("advice"),
    )


def external_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as outside knowledge entries, with duplicates and blank ids."""
    p = F.col("p_partkey")
    eid = (4600 + p % 120).cast("string")
    return table(spark, sf_dir, "part").select(
        F.when(p % 17 == 3, " ").when(p % 5 == 0, _text(" ", eid, " ")).otherwise(eid).alias("eventID"),
        F.when(p % 3 == 0, F.col("p_name")).when(p % 3 == 1, "").alias("name"),
        F.when(p % 2 == 0, F.col("p_brand")).alias("subCategory"),
        F.when(p % 4 != 0, F.col("p_type")).alias("description"),
        pick(("Information", "Error", "critical ", "Warning", None), p % 5).alias("level"),
        pick(("Yes", "no", None, "TRUE now"), p % 4).alias("securityMonitoringRecommandation"),
        F.when(p % 6 == 0, _text("Advice ", p)).alias("advice"),
        F.when(p % 2 == 1, _text("Recommended ", p)).alias("recommendation"),
        p.alias("row_no"),
    )


def decoded_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as decoded packets, one struct per layer."""
    return as_decoded_packets(table(spark, sf_dir, "lineitem"))


def as_decoded_packets(lineitem: DataFrame) -> DataFrame:
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    flag = F.col("l_returnflag")
    hw_only = (ln == 7) & (pk % 3 == 0)
    proto = F.when(flag == "A", 6).when(flag == "N", 17).when(ln % 2 == 0, 1).when(pk % 2 == 0, 47).otherwise(0)
    port = pick(PACKET_PORTS, pk % 8)
    seq = ok * 8 + ln
    return lineitem.select(
        seq.alias("seq"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(
            ~hw_only,
            F.struct(
                ip_of(sk % 200, ln % 5).alias("src"),
                ip_of(pk % 200, ok % 5).alias("dst"),
                proto.alias("proto"),
            ),
        ).alias("ip"),
        F.when(~hw_only & (flag == "A"), F.struct(port.alias("dport"))).alias("tcp"),
        F.when(~hw_only & (flag == "N"), F.struct(port.alias("dport"))).alias("udp"),
        F.when(~hw_only & (flag == "R") & (ln % 2 == 0), F.struct(F.lit(8).alias("type"))).alias("icmp"),
        F.struct(_text("aa:bb:", sk % 50).alias("src"), _text("cc:dd:", pk % 50).alias("dst")).alias("eth"),
        F.floor("l_quantity").cast("int").alias("length"),
        _text("pkt ", seq).alias("summary"),
    )


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as sockets of many hosts."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        _text("h", c % 50).alias("host"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(k % 9 == 0, "udp").otherwise("tcp").alias("proto"),
        F.when(F.col("o_orderstatus") == "P", "ESTABLISHED").otherwise("LISTEN").alias("state"),
        pick(LISTEN_PORTS, k % 12).alias("port"),
        F.when(k % 20 == 10, 0).when(k % 10 != 0, c + F.when(k % 17 == 0, 1000000).otherwise(0)).alias("pid"),
    )


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as processes of many hosts; every third is seen twice, and was another before."""
    k = F.col("c_custkey")
    seen = F.explode(F.when(k % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("n")
    twice = table(spark, sf_dir, "customer").select(k.alias("k"), seen)
    return twice.select(
        _text("h", F.col("k") % 50).alias("host"),
        F.col("k").alias("pid"),
        F.when(F.col("n") == 0, "zz_before.exe").otherwise(_text("app", F.col("k") % 20, ".exe")).alias("application"),
        F.timestamp_seconds(F.col("n") * 60).alias("ts"),
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as named services; one of them doubles a common port."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.when(p == 190, 443).otherwise(30 * p + 1).cast("int").alias("port"),
        F.translate("p_name", " ", "_").alias("service"),
    )


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as analysis answers: plain, fenced, incomplete, broken."""
    k = F.col("conv_id") * 100 + F.col("turn")
    form = k % 7
    label = pick(ANSWER_LABELS, F.length("text") % 9)
    words = F.regexp_replace("text", "[^A-Za-z ]", "")
    risk = F.when(form == 6, F.lit('"risk_score": 5')).otherwise(_text('"risk_score": "', label, '"'))
    body = _text(
        "{", risk, ', "user_entity": "', F.col("role"), '", "summary": "', words, '"',
        F.when(form == 3, "").otherwise(_text(', "advice": "Review turn ', F.col("turn"), '"')),
        F.when(form == 5, F.lit(', "event_id_explanation": "Known event"')).otherwise(""),
        F.when(form == 4, "").otherwise("}"),
    )
    raw = (
        F.when(form == 1, _text("Here it is:\n```json\n", body, "\n```\nDone"))
        .when(form == 2, _text("```\n", body, "\n```"))
        .otherwise(_text(" ", body, "\n"))
    )
    return table(spark, sf_dir, "conversations").select(
        F.lit(None).cast("string").alias("host"),
        F.when(k % 2 == 0, "Security").otherwise("Sysmon").alias("log_source"),
        k.alias("record_id"),
        raw.alias("raw_response"),
    )


def overlapping(events: DataFrame) -> DataFrame:
    """Raw events as two reads that overlap: every fifth record comes twice."""
    return events.unionByName(events.filter(F.col("record_id") % 5 == 0))


def two_hosts(events: DataFrame) -> DataFrame:
    """The events dealt to two hosts whose record numbers are the same."""
    k = F.col("record_id")
    return events.withColumn("host", F.when(k % 2 == 0, "h0").otherwise("h1")).withColumn("record_id", F.floor(k / 2).cast("long"))


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as addresses that are blocked already."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(ip_of(k % 200, F.floor(k / 200) % 5).alias("ip")).distinct()


def range_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a feed of nested address ranges of many lengths, and single addresses."""
    k = F.col("o_orderkey")
    length = pick((8, 14, 16, 20, 24, 26, 29, 32), k % 8)
    ip = ip_of(k % 1117, F.floor(k / 1117) % 256)
    return table(spark, sf_dir, "orders").select(
        F.when(length == 32, ip).otherwise(_text(ip, "/", length)).alias("ip"),
        pick(("Botnet", "Malware", "Scan"), k % 3).alias("category"),
        (1 + k % 100).cast("string").alias("confidence"),
        k.alias("row_no"),
    )
