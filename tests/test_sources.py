import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wardlake import schemas
from wardlake.sources import events as ev
from wardlake.sources import logs as store
from wardlake.sources import lookups, snapshots

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def stored(spark, *rows):
    """(id, seconds, risk) rows of the log table."""
    data = [(None, None, i, T0 + dt.timedelta(seconds=s, microseconds=700000), "4625", "m", None, r, r, None) for i, s, r in rows]
    return spark.createDataFrame(data, schemas.STORED_LOG)


def test_append_scan_clear(spark, tmp_path):
    path = str(tmp_path / "logs")
    store.create_table(spark, path)
    assert store.read_table(spark, path).count() == 0
    store.append(stored(spark, (1, 0, "High"), (2, 5, "Low")), path)
    store.append(stored(spark, (3, 5, None)), path)
    store.create_table(spark, path)
    table = store.read_table(spark, path)
    assert table.schema.fieldNames() == schemas.STORED_LOG.fieldNames()
    assert [r.id for r in store.scan(table).collect()] == [3, 2, 1]
    assert [r.id for r in store.scan(table, 2, newest_first=False).collect()] == [1, 2]
    assert table.filter("id = 1").first().timestamp == T0
    store.clear(spark, path)
    assert store.read_table(spark, path).count() == 0
    store.append(stored(spark, (4, 0, "High")), path)
    assert store.read_table(spark, path).count() == 1


def test_a_batch_writes_few_files_a_day(spark, tmp_path):
    """However many tasks hold the rows of a micro-batch, those of a day come together."""
    path = tmp_path / "logs"
    rows = stored(spark, *[(i, 86400 * (i % 5), "Low") for i in range(400)]).repartition(16)
    store.append_batch(rows, str(path), "a")
    files = list(path.glob("log_date=*/batch=a/*.parquet"))
    assert len({f.parent for f in files}) == 5 and len(files) < 10
    assert sorted(r.id for r in store.read_table(spark, str(path)).collect()) == list(range(400))


def test_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "logs")
    store.append_batch(stored(spark, (1, 0, "High")), path, "s-0")
    store.append_batch(stored(spark, (2, 0, "High")), path, "s-1")
    store.append_batch(stored(spark, (2, 0, "Low")), path, "s-1")
    assert {(r.id, r.risk_score) for r in store.read_table(spark, path).collect()} == {(1, "High"), (2, "Low")}


def test_added_column(spark, tmp_path):
    path = str(tmp_path / "logs")
    old = stored(spark, (1, 0, "High")).drop("mitre_technique", "risk_score_raw").withColumn("log_date", F.to_date("timestamp")).withColumn("batch", F.lit("old"))
    old.write.partitionBy(*store.PARTITIONS).parquet(path)
    store.append(stored(spark, (2, 0, "Low")).withColumn("mitre_technique", F.lit("T1")), path)
    got = {r.id: r.mitre_technique for r in store.read_table(spark, path).collect()}
    assert got == {1: None, 2: "T1"}


def test_days_outside_the_bounds_are_not_read(spark, tmp_path):
    path = str(tmp_path / "logs")
    store.append(stored(spark, *[(i, 86400 * i, "High") for i in range(5)]), path)
    some = store.read_table(spark, path, since=T0 + dt.timedelta(days=1), until=T0 + dt.timedelta(days=3))
    assert sorted(r.id for r in some.collect()) == [1, 2]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "log_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_scan_with_limit_is_top_k(spark):
    plan = store.scan(stored(spark, (1, 0, "High")), 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_export_and_archive(spark, tmp_path):
    logs = stored(spark, (1, 0, "Yüksek")).withColumn("message", F.lit('a\n"b", c'))
    target = store.export_csv(logs, str(tmp_path), dt.datetime(2024, 5, 6, 7, 8, 9))
    assert target.endswith("logs_20240506_070809.csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(target).first()
    assert back.message == 'a\n"b", c' and back.severity == "Critical"
    archive = tmp_path / "archive.csv"
    archive.write_text(
        'ID,Zaman,Event ID,Mesaj,AI Analiz,Risk Seviyesi\n1,2024-12-01 10:15:23,4672,"line one\n\tline ""two""\n",note,Orta\n'
        "2,bad,1,m,n,Düşük\n",
        encoding="utf-8",
    )
    rows = store.read_archive(spark, str(archive)).orderBy("id").collect()
    assert rows[0].message == 'line one\n\tline "two"\n' and rows[0].timestamp == dt.datetime(2024, 12, 1, 10, 15, 23)
    assert (rows[0].risk_score, rows[0].risk_score_raw) == ("Medium", "Orta") and len(rows) == 2


FEED = """ip,category,confidence
1.2.3.4,Botnet,100
 5.6.7.8 , BruteForce ,90
8.8.8.8,Benign,0
1.1.1.1,benign,50
9.9.9.9,Spam,0
,Spam,10
1.2.3.4,Malware,55
7.7.7.7,Scan,many
"""


def test_feed(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text(FEED)
    feed = lookups.read_feed(spark, str(path))
    assert {tuple(r) for r in feed.collect()} == {("1.2.3.4", "Malware", 55), ("5.6.7.8", "BruteForce", 90)}
    assert lookups.feed_size(feed).first()[0] == 2
    assert lookups.read_feed(spark, str(tmp_path / "missing.csv")).count() == 0


def test_knowledge_files(spark, tmp_path):
    local, outside = tmp_path / "local.json", tmp_path / "outside.json"
    local.write_text(json.dumps({"4625": {"title": "Fail", "description": "d", "risk_level": "Orta", "advice": "a"}, "7": {"title": "Seven"}}, ensure_ascii=False))
    outside.write_text(json.dumps([
        {"eventID": "4625", "name": "other"},
        {"eventID": " 4798 ", "subCategory": "Sub", "level": "Information"},
        {"eventID": "", "name": "blank"},
        {"eventID": "1", "name": "old", "level": "Error"},
        {"eventID": "1", "name": "", "securityMonitoringRecommandation": "Yes", "recommendation": "look"},
    ]))
    kb = lookups.merge_knowledge(lookups.read_local_knowledge(spark, str(local)), lookups.read_external_knowledge(spark, str(outside)))
    rows = {r.event_id: r for r in kb.collect()}
    assert sorted(rows) == ["1", "4625", "4798", "7"]
    assert (rows["4625"].title, rows["4625"].source) == ("Fail", "local")
    assert (rows["7"].risk_level, rows["7"].advice) == (lookups.LOCAL_RISK, lookups.LOCAL_ADVICE)
    assert (rows["4798"].title, rows["4798"].risk_level, rows["4798"].advice) == ("Sub", "Düşük", lookups.OUTSIDE_ADVICE)
    assert (rows["1"].title, rows["1"].risk_level, rows["1"].advice) == ("Event 1", "Yüksek", "look")
    outside.write_text(json.dumps({"12": {"name": "n", "level": "critical"}}))
    keyed = lookups.read_external_knowledge(spark, str(outside)).collect()
    assert [(r.event_id, r.title, r.risk_level) for r in keyed] == [("12", "n", "Yüksek")]
    assert lookups.read_local_knowledge(spark, str(tmp_path / "no.json")).count() == 0


def test_channels(spark, tmp_path):
    row = lambda i, s, at: (None, i, s, "1", at, "m", None, None)
    one = spark.createDataFrame([row(1, None, T0), row(2, None, T0 + dt.timedelta(seconds=3))], schemas.RAW_EVENT)
    one.write.json(str(tmp_path / "sec"))
    spark.createDataFrame([row(1, None, T0 - dt.timedelta(seconds=5))], schemas.RAW_EVENT).write.parquet(str(tmp_path / "sys"))
    merged = ev.merge_channels(
        ev.read_channel(spark, str(tmp_path / "sec"), "Security", "json"),
        ev.read_channel(spark, str(tmp_path / "sys"), "Sysmon"),
    )
    order = [(r.log_source, r.record_id) for r in ev.in_time_order(merged).orderBy("arrival").collect()]
    assert order == [("Sysmon", 1), ("Security", 1), ("Security", 2)]
    assert ev.since(merged, T0).count() == 2  # exactly five seconds before is out


@pytest.mark.parametrize(
    "layers, want",
    [
        (dict(ip=("1.1.1.1", "2.2.2.2", 6), tcp=(443,)), ("1.1.1.1", "2.2.2.2", "TCP", 443)),
        (dict(ip=("1.1.1.1", "2.2.2.2", 17), udp=(53,)), ("1.1.1.1", "2.2.2.2", "UDP", 53)),
        (dict(ip=("1.1.1.1", "2.2.2.2", 1), icmp=(8,)), ("1.1.1.1", "2.2.2.2", "ICMP", None)),
        (dict(ip=("1.1.1.1", "2.2.2.2", 47)), ("1.1.1.1", "2.2.2.2", "47", None)),
        (dict(eth=("aa", "bb")), ("aa", "bb", "Ethernet", None)),
        (dict(), (None, None, None, None)),
    ],
)
def test_flatten_packets(spark, layers, want):
    schema = (
        "seq long, ts timestamp, length int, summary string, ip struct<src:string,dst:string,proto:int>, "
        "tcp struct<dport:int>, udp struct<dport:int>, icmp struct<type:int>, eth struct<src:string,dst:string>"
    )
    row = (1, T0, 60, "s") + tuple(layers.get(k) for k in ("ip", "tcp", "udp", "icmp", "eth"))
    got = snapshots.flatten_packets(spark.createDataFrame([row], schema)).first()
    assert (got.source_ip, got.dest_ip, got.protocol, got.port) == want


def test_newest_rows_read_the_last_days_only(spark, tmp_path):
    path, start = str(tmp_path / "t"), dt.datetime(2024, 1, 1)
    times = F.lit(start) + F.make_interval(mins=(F.col("id") * 360).cast("int"))
    rows = spark.range(60 * 4).select("id", times.alias("timestamp"), F.lit("1").alias("event_id"), F.lit("High").alias("risk_score"))
    store.append(rows.coalesce(1), path)
    store.append(rows.filter("id % 97 = 0").withColumn("id", F.col("id") + 10_000).coalesce(1), path, "second")
    every = store.read_table(spark, path)
    sizes = (1, 4, 7, 500)
    want = {n: [r.id for r in store.scan(every, n).collect()] for n in sizes}
    assert {n: [r.id for r in store.read_newest(spark, path, n).collect()] for n in sizes} == want and len(want[500]) == 243
    for day in sorted((tmp_path / "t").glob("log_date=*"))[:-2]:
        for f in day.rglob("*.parquet"):
            f.write_text("not parquet")
            (f.parent / f".{f.name}.crc").unlink()
    assert {n: [r.id for r in store.read_newest(spark, path, n).collect()] for n in sizes[:3]} == {n: want[n] for n in sizes[:3]}


def test_archive_read_by_many_tasks(spark, tmp_path):
    """Quotes, line ends and empty lines inside fields, over blocks of a few bytes: equal to the reader of whole files."""
    import random

    rng = random.Random(9)
    pieces = ("plain", 'say ""hi""', "line\nbreak", "\n\n", "a,b", "", " spaced ", "é漢", '""', "back\\slash", "win\r\nend")
    paths = [tmp_path / "in" / f"{k}.csv" for k in range(2)]
    paths[0].parent.mkdir()
    for k, path in enumerate(paths):
        end = "\r\n" if k else "\n"
        rows = [",".join(store.ARCHIVE_HEADER)]
        for i in range(120):
            text = " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
            rows.append(f'{i},2024-01-0{1 + k} 00:00:00,"4625","{text}","x{text}",High')
        path.write_text(end.join(rows) + end, encoding="utf-8", newline="")
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    want = sorted((int(r[0]), r[1][:10], r[3], r[4]) for r in reader.csv(str(tmp_path / "in")).collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            found = store.read_archive(spark, str(tmp_path / "in"))
            assert sorted((r.id, str(r.timestamp)[:10], r.message, r.ai_analysis) for r in found.collect()) == want
            records = store.csv_records(spark, str(tmp_path / "in"))
            assert records.count() == 240
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
