import datetime as dt

from pyspark.sql import functions as F

from replay import START, replay
from test_detection import CHAIN, busy_rows
from wardlake import schemas
from wardlake.operators import traffic
from wardlake.operators.rules import by_severity, rule_from_dict
from wardlake.sources import events as ev
from wardlake.sources import logs as store
from wardlake.sources import snapshots
from wardlake.streaming import jobs, state


def raw_row(row):
    rid, source, code, at, message, det = row
    inserts = None
    if det is not None:
        inserts = [f"v{i}" for i in range(21)]
        inserts[4], inserts[10], inserts[12], inserts[19] = det[:4]
    return (None, rid, source, code, at, message, inserts, None)


def write_parts(spark, rows, path, parts):
    """Rows as one file per part, in time order of arrival."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = rows[i * size : (i + 1) * size]
        spark.createDataFrame(part, schemas.RAW_EVENT).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_replay_over_many_batches(spark, tmp_path):
    rows = [r if r[5] or r[2] != "1" else (*r[:5], ("N/A",) * 4 + (None,)) for r in busy_rows(5, 600)]
    rows.sort(key=lambda r: (r[3], r[1], r[0]))
    write_parts(spark, [raw_row(r) for r in rows], str(tmp_path / "in"), 3)
    stream = ev.stream_channel(spark, str(tmp_path / "in"), max_files=1)
    # One channel name per event comes with the data here.
    out = str(tmp_path / "out")
    jobs.detect_stream(stream, CHAIN, out, available_now=True, kept=dt.timedelta(days=1)).awaitTermination()
    found = spark.read.parquet(f"{out}/detections")
    assert found.select("batch").distinct().count() == 3
    got = {r[0]: [r[1]] if r[1] else [] for r in found.select("record_id", "detection.rule_id").collect()}
    details = [(*r[:5], r[5] or (("N/A",) * 4 + (None,) if r[2] == "1" else None)) for r in rows]
    assert got == replay(details, by_severity(CHAIN), True)


def simple(spark, *rows):
    data = [(None, i, s, e, START + dt.timedelta(seconds=t), m, None, None) for i, s, e, t, m in rows]
    return spark.createDataFrame(data, schemas.RAW_EVENT)


RULES = [rule_from_dict({"id": "t", "severity": "high", "mitre": "T1110", "conditions": {"event_id": 4625, "threshold": 3}})]


def test_event_job(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    simple(spark, (1, "Security", "4625", 0, "8.8.8.8"), (2, "Security", "4625", 1, "m")).write.parquet(src)
    feed_rows = [("1.2.3.4", "Botnet", 100)]
    feed = lambda: spark.createDataFrame(feed_rows, schemas.THREAT_FEED)

    def run():
        stream = ev.stream_channel(spark, src)
        jobs.process_stream(stream, lambda: RULES, feed, out, available_now=True).awaitTermination()
        return {r.id: r for r in store.read_table(spark, f"{out}/logs").collect()}

    first = run()
    assert [first[i].risk_score for i in (1, 2)] == ["Medium", "Medium"]
    # Later files: a record read again, one that completes the threshold, one from a newly listed address.
    feed_rows.append(("5.5.5.5", "Scan", 70))
    simple(
        spark,
        (2, "Security", "4625", 1, "m"),
        (3, "Security", "4625", 2, "8.8.8.8"),
        (4, "Security", "4624", 3, "5.5.5.5"),
    ).write.mode("append").parquet(src)
    second = run()
    assert sorted(second) == [1, 2, 3, 4]
    assert [second[i].risk_score for i in (1, 2, 3, 4)] == ["Medium", "Medium", "High", "High"]
    assert second[3].mitre_technique == "T1110"
    assert store.read_table(spark, f"{out}/logs").count() == 4
    blocks = {r.ip for r in jobs.read_blocks(spark, out).collect()}
    assert blocks == {"8.8.8.8", "5.5.5.5"}
    # An address that is blocked already is not added a second time.
    simple(spark, (5, "Security", "4624", 4, "5.5.5.5 again")).write.mode("append").parquet(src)
    run()
    assert jobs.read_blocks(spark, out).count() == 2


def run_batches(spark, folder, *batches, rules=RULES, kept=dt.timedelta(minutes=10)):
    """Rules found for each record of consecutive micro-batches, and the late records."""
    from wardlake.operators.detect import Plan, join_record, rule_numbers
    from wardlake.session import cut_lineage
    from wardlake.sources.events import prepare

    found, late = {}, []
    for k, batch in enumerate(batches):
        events, own = batch if isinstance(batch, tuple) else (batch, rules)
        st = state.EventState(spark, folder, k, own, kept)
        fresh, behind = st.admit(events)
        fresh, prepared = fresh.persist(), prepare(fresh)
        plan = Plan.of(spark, st.rules)
        facts = cut_lineage(st.facts(prepared, plan))
        for _ in range(2):  # a repeated attempt changes nothing
            st.advance(fresh, prepared)
        rows = plan.reported(join_record(fresh, rule_numbers(facts, plan)))
        found |= {r[0]: r[1] for r in rows.select("record_id", "detection.rule_id").collect()}
        late += [r.record_id for r in behind.collect()]
        fresh.unpersist()
    return found, late


def state_after(spark, folder, batch_id, events, idle=state.IDLE):
    """One more micro-batch, of which only the state matters."""
    from wardlake.sources.events import prepare

    st = state.EventState(spark, folder, batch_id, RULES, dt.timedelta(minutes=10), idle)
    fresh, _ = st.admit(events)
    st.advance(fresh, prepare(fresh))
    return st


def test_batches_share_history_and_forget(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "DROP_EVERY", 1)
    one = simple(spark, (1, "S", "4625", 0, "m"), (2, "S", "4625", 30, "m"))
    two = simple(spark, (3, "S", "4625", 50, "m"), (4, "S", "4625", 95, "m"), (2, "S", "4625", 30, "m"))
    three = simple(spark, (5, "S", "4624", 5000, "m"))
    folder = str(tmp_path / "state")
    found, late = run_batches(spark, folder, one, two, three)
    assert (found, late) == ({1: None, 2: None, 3: "t", 4: None, 5: None}, [])
    state_after(spark, folder, 3, simple(spark, (6, "S", "4624", 5001, "m")))
    assert state.EventState(spark, folder, 4, RULES, dt.timedelta(0)).tail.read().count() == 0
    assert not (tmp_path / "state/tail/rows/0-0").exists()
    assert state.horizon(RULES) == dt.timedelta(seconds=60)


def test_lagging_channel_and_late_event_lose_nothing(spark, tmp_path):
    fast = simple(spark, (1, "A", "4625", 7200, "m"), (2, "A", "4625", 7210, "m"))
    slow = simple(spark, (1, "B", "4625", 0, "m"), (2, "B", "4625", 10, "m"), (3, "B", "4625", 20, "m"))
    events = simple(spark, (9, "B", "4625", 30, "m"))
    found, late = run_batches(spark, str(tmp_path / "a"), fast, slow, events)
    assert late == [] and found[9] == "t" and found[3] == "t"
    # 80 seconds behind its own channel, with a window of 60
    first = simple(spark, (1, "S", "4625", 0, "m"), (2, "S", "4625", 5, "m"), (7, "S", "4624", 90, "m"))
    found, late = run_batches(spark, str(tmp_path / "b"), first, simple(spark, (3, "S", "4625", 10, "m")))
    assert late == [] and found[3] == "t"
    # further behind than what is kept: set aside, not lost
    far = simple(spark, (8, "S", "4625", -4000, "m"))
    assert run_batches(spark, str(tmp_path / "c"), first, far)[1] == [8]


def test_channel_two_days_behind_loses_nothing(spark, tmp_path):
    day = 86400
    first = simple(spark, (1, "A", "4624", 2 * day, "m"), (1, "B", "4625", 0, "m"))
    second = simple(spark, (2, "A", "4624", 2 * day + 9, "m"), (2, "B", "4625", 10, "m"))
    # records 1 and 2 of the slow channel are read once more
    third = simple(spark, (9, "B", "4625", 20, "m"), (1, "B", "4625", 0, "m"), (2, "B", "4625", 10, "m"))
    folder = str(tmp_path / "a")
    found, late = run_batches(spark, folder, first, second, third)
    assert late == [] and found[9] == "t"
    seen = state.EventState(spark, folder, 3, RULES, dt.timedelta(0)).seen.read().filter("log_source = 'B'")
    assert sorted(r.record_id for r in seen.collect()) == [1, 2, 9]


def test_events_without_time_are_seen_once(spark, tmp_path):
    timeless = simple(spark, (1, "S", "4624", 0, "m")).withColumn("event_time", F.lit(None).cast("timestamp"))
    timed = simple(spark, (2, "S", "4624", 0, "m"), (3, "S", "4624", 5000, "m"))
    folder = str(tmp_path / "a")
    run_batches(spark, folder, timeless.unionByName(timed), timed.limit(0))
    fresh, late = state.EventState(spark, folder, 2, RULES, dt.timedelta(minutes=10)).admit(timeless)
    assert (fresh.count(), late.count()) == (0, 0)


def test_silent_channel_holds_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "DROP_EVERY", 1)
    batches = [simple(spark, (2, "B", "4625", 0, "m")), simple(spark, (1, "A", "4625", 172800, "m")), simple(spark, (3, "A", "4624", 172805, "m"))]

    def left(folder, idle):
        for k, batch in enumerate((*batches, batches[-1])):
            state_after(spark, folder, k, batch, idle)
        return state.EventState(spark, folder, 4, RULES, dt.timedelta(0)).tail.read().count()

    assert left(str(tmp_path / "a"), dt.timedelta(0)) == 1
    assert left(str(tmp_path / "b"), None) == left(str(tmp_path / "c"), state.IDLE) == 2


def test_wrong_clock_keeps_the_history(spark, tmp_path):
    now = int((dt.datetime.now() - START).total_seconds())
    one = simple(spark, (1, "S", "4625", now, "m"), (2, "S", "4625", now + 1, "m"), (6, "T", "4624", now + 10**8, "m"))
    found, late = run_batches(spark, str(tmp_path / "s"), one, simple(spark, (3, "S", "4625", now + 2, "m")))
    assert late == [] and found[3] == "t"


def test_rules_gone_for_a_while_and_broken_pattern(spark, tmp_path):
    bad = rule_from_dict({"id": "bad", "severity": "critical", "conditions": {"event_id": 4625, "message_regex": "(no"}})
    parts = [simple(spark, (i, "S", "4625", 10 * i, "m")) for i in (1, 2, 3)]
    found, _ = run_batches(spark, str(tmp_path / "s"), (parts[0], [bad, *RULES]), (parts[1], []), (parts[2], RULES))
    assert found == {1: None, 2: None, 3: "t"}


def test_missing_state_is_an_error(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        run_batches(spark, str(tmp_path / "s"), simple(spark, (1, "S", "1", 0, "m")))
        state_after(spark, str(tmp_path / "s"), 5, simple(spark, (2, "S", "1", 0, "m")))


def test_answers_that_come_later(spark, tmp_path):
    import json

    from wardlake.operators.enrich import parse_answers

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    simple(spark, (1, "Security", "4624", 0, "8.8.8.8"), (2, "Security", "4624", 1, "m")).write.parquet(src)
    kb = spark.createDataFrame([("4624", "t", "d", "Low", "Look", "local")], schemas.KNOWLEDGE)
    jobs.process_stream(
        ev.stream_channel(spark, src), RULES, None, out, available_now=True, knowledge=kb, wait=True
    ).awaitTermination()
    prompts = spark.read.parquet(f"{out}/prompts").collect()
    assert len(prompts) == 2 and all("Look" in r.system_prompt for r in prompts)
    assert not (tmp_path / "out/logs").exists()
    text = json.dumps({"risk_score": "High", "user_entity": "u", "summary": "s", "advice": "a"})
    rows = [(None, "Security", 1, "4624", START, "{"), (None, "Security", 1, "4624", START + dt.timedelta(1), text), (None, "Sysmon", 2, "1", START, text)]
    answers = spark.createDataFrame(rows, schemas.ANSWER)
    parse_answers(answers).write.parquet(f"{out}/answers")
    stream = spark.readStream.schema(spark.read.parquet(f"{out}/answers").schema).parquet(f"{out}/answers")
    jobs.answer_stream(stream, out, available_now=True).awaitTermination()
    assert [(r.id, r.risk_score) for r in store.read_table(spark, f"{out}/logs").collect()] == [(1, "High")]
    assert [r.ip for r in jobs.read_blocks(spark, out).collect()] == ["8.8.8.8"]
    jobs.expire_pending(spark, out, "end")
    got = {r.id: r for r in store.read_table(spark, f"{out}/logs").collect()}
    assert sorted(got) == [1, 2] and "4624" in got[2].ai_analysis and got[2].log_source == "Security"
    assert jobs.read_pending(spark, out).count() == 0


def test_released_address_can_be_blocked_again(spark, tmp_path):
    from wardlake.operators.respond import not_blocked

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed = spark.createDataFrame([("5.5.5.5", "Scan", 70)], schemas.THREAT_FEED)

    def run(rid):
        simple(spark, (rid, "Security", "4624", rid, "5.5.5.5")).write.mode("append").parquet(src)
        jobs.process_stream(ev.stream_channel(spark, src), RULES, feed, out, available_now=True).awaitTermination()

    run(1)
    ips = spark.createDataFrame([("5.5.5.5",)], "ip string")
    assert not_blocked(ips, jobs.read_blocks(spark, out)).count() == 0
    jobs.release(ips, out)
    assert jobs.read_blocks(spark, out).count() == 0 and not_blocked(ips, jobs.read_blocks(spark, out)).count() == 1
    run(2)
    assert [r.ip for r in jobs.read_blocks(spark, out).collect()] == ["5.5.5.5"]


def test_counters_and_running_counts(spark, tmp_path):
    rows = [(i, START + dt.timedelta(seconds=i), f"s{i % 3}", "d", "TCP", 80, 1, "x") for i in range(30)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, schemas.PACKET).coalesce(1).write.mode("append").parquet(src)
    jobs.count_stream(snapshots.stream_packets(spark, src, max_files=1), out, available_now=True).awaitTermination()
    want = {tuple(r) for r in traffic.traffic_counts(snapshots.read_packets(spark, src)).collect()}
    assert {tuple(r) for r in jobs.read_counters(spark, out).collect()} == want
    merged = str(tmp_path / "merged")
    jobs.count_stream(snapshots.stream_packets(spark, src, max_files=1), merged, available_now=True, merge_every=1).awaitTermination()
    assert {tuple(r) for r in jobs.read_counters(spark, merged).collect()} == want
    assert [p.name for p in (tmp_path / "merged/counts").iterdir()] == ["batch=1"]
    query = (
        jobs.running_counts(snapshots.stream_packets(spark, src)).writeStream.format("memory").queryName("running")
        .outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("running").collect()} == want


def test_timeline_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    simple(spark, *[(i, "S", "1", 600 * i, "m") for i in range(12)]).write.parquet(src)
    stream = ev.stream_channel(spark, src).select(F.col("event_time").alias("timestamp"))
    jobs.timeline_stream(stream).writeStream.format("memory").queryName("steps").outputMode("append").trigger(
        availableNow=True
    ).start().awaitTermination()
    got = {r.time_interval: r.log_count for r in spark.table("steps").collect()}
    # Only steps the watermark has passed are final.
    assert got[START] == 2 and max(got) <= START + dt.timedelta(seconds=6600 - 600)


def test_interval_trigger(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    simple(spark, (1, "S", "4625", 0, "m")).write.parquet(src)
    query = jobs.detect_stream(ev.stream_channel(spark, src, "Security"), RULES, out)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(f"{out}/detections").first().log_source == "Security"
