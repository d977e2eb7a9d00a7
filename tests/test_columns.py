import ipaddress

import pytest
from pyspark.sql import functions as F

from wardlake.functions import ip as ipf
from wardlake.functions import risk, text
from wardlake.sources.events import prepare
from wardlake import schemas


def one(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_extract_ips(spark):
    texts = ["none", "1.2.3.4 and 5.6.7.8, 1.2.3.4", "999.1.1.1 010.1.1.1 1.2.3.4.5", "x1.2.3.4 é1.2.3.4", None]
    assert one(spark, texts, ipf.extract_ips) == [[], ["1.2.3.4", "5.6.7.8", "1.2.3.4"], ["1.2.3.4"], [], None]


def test_private_ranges_equal_stdlib(spark):
    edges = []
    for net in ipf.PRIVATE_RANGES:
        n = ipaddress.ip_network(net)
        edges += [n[0] - 1 if int(n[0]) else n[0], n[0], n[-1], n[-1] + 1 if int(n[-1]) < 2**32 - 1 else n[-1]]
    edges += [ipaddress.ip_address(a) for a in ("192.0.0.9", "192.0.0.10", "192.0.0.170", "100.64.0.1", "8.8.8.8", "224.0.0.1")]
    edges += [ipaddress.ip_address(i * 40503 * 7 % 2**32) for i in range(3000)]
    texts = [str(a) for a in edges]
    want = [a.is_private or a.is_loopback or a.is_link_local for a in edges]
    assert one(spark, texts, ipf.is_private_ip) == want
    assert one(spark, ["1.2.3", "256.1.1.1", "", None], ipf.is_private_ip) == [False] * 4
    assert one(spark, ["0.0.1.2", "255.255.255.255", "x"], ipf.ipv4_number) == [258, 2**32 - 1, None]


def test_block_rule_name(spark):
    assert one(spark, ["1.2.3.4"], ipf.block_rule_name) == ["wardlake_Block_1_2_3_4"]


def test_user_from_message(spark):
    texts = ["Account Name:\t\t-\nUser Name: bob", "USER NAME:  ann x", "Account Name carl", "Unknown user name or", "", None, "nothing"]
    assert one(spark, texts, text.user_from_message) == ["-", "ann", "carl", "name", None, None, None]


def test_event_id_from_text(spark):
    texts = ["Event ID: 4625", "event id #7", "EVENT ID 12 Event ID: 3", "Event 5"]
    assert one(spark, texts, text.event_id_from_text) == ["4625", "7", "12", None]


def test_strip_removes_all_white_space(spark):
    assert one(spark, ["\t a b\n ", "", None], text.strip) == ["a b", "", None]


def test_risk_labels(spark):
    labels = ["High", "yüksek", " medium ", "important", "following", "Critical", "", None, "n/a", "YÜKSEK"]
    assert one(spark, labels, risk.answer_risk) == [
        "Yüksek", "Yüksek", "Orta", "Orta", "Düşük", "Orta", "Orta", "Orta", "Orta", "Yüksek"]
    assert one(spark, labels, risk.display_risk) == [
        "High", "High", "Medium", "Medium", "Low", "Critical", "", "Unspecified", "n/a", "High"]
    assert one(spark, labels, risk.risk_bucket) == [
        "High", "High", "Medium", "Medium", "Low", "Unspecified", "Unspecified", "Unspecified", "Unspecified", "High"]
    assert one(spark, labels, risk.severity_label)[:6] == ["Critical", "Critical", "Medium", "Medium", "Low", "Unspecified"]
    assert one(spark, ["High", "Yüksek", "high", None], risk.is_high) == [True, True, False, False]
    assert one(spark, ["critical", "high", "medium", "low", "odd"], risk.severity_to_risk) == ["High", "High", "Medium", "Low", "Medium"]
    assert one(spark, ["critical", "low", "odd"], risk.severity_rank) == [0, 3, 99]


def raw(spark, *rows):
    data = [(None, i, s, e, None, m, ins, x) for i, (s, e, m, ins, x) in enumerate(rows)]
    import datetime as dt

    data = [r[:4] + (dt.datetime(2024, 1, 1),) + r[5:] for r in data]
    return spark.createDataFrame(data, schemas.RAW_EVENT)


def test_event_message(spark):
    df = raw(spark, ("S", "1", "text", ["a"], None), ("S", "1", " \n", ["a", "", None], None), ("S", "1", None, None, None))
    got = [r.message for r in prepare(df).orderBy("record_id").collect()]
    assert got == ["text", "a |  | None", "Message could not be retrieved"]


def inserts(**at):
    values = [f"v{i}" for i in range(21)]
    for key, value in at.items():
        values[int(key[1:])] = value
    return values


def test_process_details_by_position(spark):
    full, shifted = inserts(), inserts(_0="")
    df = raw(
        spark,
        ("Sysmon", "1", "m", full, None),
        ("Sysmon", "1", "m", shifted, None),
        ("Sysmon", "1", "m", full[:6], None),
        ("Sysmon", "5", "m", full, None),
        ("Security", "1", "m", full, None),
        ("Sysmon", "1", "m", None, None),
    )
    rows = [r.details for r in prepare(df).orderBy("record_id").collect()]
    assert tuple(rows[0]) == ("v4", "v10", "v12", "v19", None)
    assert tuple(rows[1]) == ("v5", "v11", "v13", "v20", None)
    assert tuple(rows[2]) == ("v4", "N/A", "N/A", "N/A", None)
    assert tuple(rows[3]) == ("v4", None, None, None, "v3")
    assert rows[4] is None
    assert tuple(rows[5]) == ("N/A", "N/A", "N/A", "N/A", None)
    strict = prepare(df, positional_strict=True).orderBy("record_id").collect()[1].details
    assert tuple(strict) == ("v4", "v10", "v12", "v19", None)


def test_process_details_from_xml(spark):
    def xml(*pairs):
        return "<Event><EventData>" + "".join(f'<Data Name="{n}">{v}</Data>' for n, v in pairs) + "</EventData></Event>"

    df = raw(
        spark,
        ("Sysmon", "1", "m", inserts(), xml(("Image", "x.exe"), ("User", ""), ("Image", "y.exe"))),
        ("Sysmon", "1", "m", inserts(), "<broken"),
        ("Sysmon", "5", "m", inserts(), xml(("ProcessId", "77"), ("CommandLine", "ignored"))),
        ("Sysmon", "1", "m", None, xml(("Image", "x.exe"), ("User", "u"))),
        ("Sysmon", "1", "m", inserts(), xml(("Image", "x.exe")).replace("<Event>", '<Event xmlns="urn:x">')),
    )
    rows = [tuple(r.details) for r in prepare(df).orderBy("record_id").collect()]
    assert rows[0] == ("y.exe", "v10", "", "v19", None)
    assert rows[1] == ("v4", "v10", "v12", "v19", None)
    assert rows[2] == ("v4", None, None, None, "77")
    assert rows[3] == ("N/A", "N/A", "N/A", "N/A", None)
    assert rows[4] == ("v4", "v10", "v12", "v19", None)  # names of another namespace


def test_combined_and_context_text(spark):
    df = raw(spark, ("Sysmon", "5", "m", ["a", "", "b", "c", "d", "e"], None), ("Security", "4625", "m", [""], None))
    rows = prepare(df).orderBy("record_id").withColumn(
        "ctx", text.context_text(F.col("log_source"), F.col("event_id"), F.col("event_time"), F.col("combined_text"))
    ).collect()
    assert rows[0].combined_text == (
        "m\nSysmon Process Terminated Details:\n  Image: e\n  ProcessId: d\n"
        "\nAdditional Details (StringInserts): a | b | c | d | e"
    )
    assert rows[1].combined_text == "m"
    assert rows[1].ctx.startswith("Log Source: Security\nEvent ID: 4625\nTime: 2024-01-01 00:00:00\nMessage: m\n\nHint: ")


@pytest.mark.parametrize("n", [500, 200])
def test_shortening_counts_characters(spark, n):
    assert one(spark, ["ü" * 600], lambda c: F.left(c, F.lit(n))) == ["ü" * n]
