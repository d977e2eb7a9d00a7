"""Streams whose state changes by what arrives: hot event ids, both sides of a wait, the block list, re-read records."""

from __future__ import annotations

import datetime as dt
import json
import random
import shutil

from replay import START, replay
from test_streaming import RULES, run_batches, simple, state_after
from wardlake import schemas
from wardlake.operators.enrich import parse_answers
from wardlake.operators.rules import by_severity, rule_from_dict
from wardlake.session import shared_dir
from wardlake.sources import events as ev
from wardlake.sources import logs as store
from wardlake.streaming import jobs, parts, state


def test_hot_event_id_over_eight_batches(spark, tmp_path, monkeypatch):
    """A third of all events bear one id; what a micro-batch writes does not grow with those before it."""
    monkeypatch.setattr(parts, "FAN", 3)
    rng = random.Random(2)
    rules = [
        rule_from_dict({"id": "hot", "severity": "high", "conditions": {"event_id": 4625, "threshold": 25, "time_window": 30}}, "a", 0),
        rule_from_dict({"id": "any", "severity": "low", "conditions": {"provider": "S", "threshold": 3, "time_window": 2}}, "a", 1),
    ]
    rows, folder = [], str(tmp_path / "state")
    for k in range(8):
        for i in range(60):
            code = "4625" if i % 3 == 0 else str(rng.randrange(4600, 4640))
            rows.append((len(rows), "S", code, 20 * k + rng.randrange(20), "m"))
    want = replay([(i, s, e, START + dt.timedelta(seconds=t), m, None) for i, s, e, t, m in rows], by_severity(rules), True)
    batches = [simple(spark, *sorted(rows[60 * k : 60 * k + 60], key=lambda r: r[3])) for k in range(8)]
    ordered = all(rows[i][3] <= rows[j][3] for i in range(0, 480, 60) for j in range(i + 60, 480))
    assert ordered
    found, late = run_batches(spark, folder, *batches, rules=rules, kept=dt.timedelta(seconds=1))
    assert late == [] and {i: [r] if r else [] for i, r in found.items()} == want and any(r == "hot" for r in found.values())
    last = state.EventState(spark, folder, 8, rules, dt.timedelta(seconds=1))
    assert spark.read.parquet(f"{folder}/tail/rows/7-7").count() <= 60 == spark.read.parquet(f"{folder}/seen/rows/7-7").count()
    assert len(last.seen.parts()) <= 4 and len(last.tail.parts()) <= 4


def test_keys_are_not_read_when_nothing_repeats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "INDEX_ROWS", 1)
    folder = str(tmp_path / "s")
    state_after(spark, folder, 0, simple(spark, *[(i, "S", "4624", i, "m") for i in range(50)]))
    state_after(spark, folder, 1, simple(spark, *[(i, "T", "4624", i, "m") for i in range(50)]))
    saved = tmp_path / "saved"
    shutil.copytree(f"{folder}/seen/rows", saved)
    for name in ("0-0", "1-1"):
        for f in (tmp_path / "s/seen/rows" / name).iterdir():
            if f.suffix == ".parquet":
                f.write_text("not parquet")
                (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    st = state.EventState(spark, folder, 2, RULES, dt.timedelta(minutes=10))
    fresh, late = st.admit(simple(spark, *[(i, s, "4624", i, "m") for i in range(50, 99) for s in "STU"]))
    assert (fresh.count(), late.count()) == (147, 0)
    shutil.rmtree(f"{folder}/seen/rows/1-1")
    shutil.copytree(saved / "1-1", f"{folder}/seen/rows/1-1")
    # a record of the second part: only that part is opened
    fresh, _ = st.admit(simple(spark, (49, "T", "4624", 49, "m"), (60, "T", "4624", 60, "m")))
    assert [r.record_id for r in fresh.collect()] == [60]


ANSWER = json.dumps({"risk_score": "High", "user_entity": "u", "summary": "s", "advice": "a"})
LOW = json.dumps({"risk_score": "Low", "user_entity": "u", "summary": "s", "advice": "a"})


class Wait:
    """An event job and an answer job, run to the end of what there is whenever asked."""

    def __init__(self, spark, path):
        self.spark, self.out = spark, str(path)

    def answers(self, *rows, **how):
        data = [(None, source, rid, "4624", START + dt.timedelta(seconds=at), text) for rid, source, at, text in rows]
        parsed = parse_answers(self.spark.createDataFrame(data, schemas.ANSWER))
        if rows:
            parsed.coalesce(1).write.mode("append").parquet(f"{self.out}/answers")
        (self.spark._jvm.java.io.File(f"{self.out}/answers")).mkdirs()
        stream = self.spark.readStream.schema(parsed.schema).parquet(f"{self.out}/answers")
        jobs.answer_stream(stream, self.out, available_now=True, **how).awaitTermination()

    def events(self, *rows):
        simple(self.spark, *rows).coalesce(1).write.mode("append").parquet(f"{self.out}/in")
        stream = ev.stream_channel(self.spark, f"{self.out}/in")
        jobs.process_stream(stream, RULES, None, self.out, available_now=True, wait=True).awaitTermination()

    def stored(self):
        try:
            rows = store.read_table(self.spark, f"{self.out}/logs").collect()
        except Exception:  # noqa: BLE001 nothing stored yet
            return []
        return sorted((r.log_source, r.id, r.risk_score) for r in rows)

    def blocked(self):
        return sorted(r.ip for r in jobs.read_blocks(self.spark, self.out).collect())


def test_each_side_waits_for_the_other(spark, tmp_path):
    w = Wait(spark, tmp_path)
    w.answers((1, "S", 0, LOW), (1, "S", 5, ANSWER), (9, "S", 0, ANSWER))  # before any event, on empty folders
    assert w.stored() == [] and jobs.read_pending(spark, w.out).count() == 0
    w.events((1, "S", "4624", 0, "8.8.8.8"), (2, "S", "4624", 1, "9.9.9.9"), (3, "S", "4624", 2, "m"), (1, "T", "4624", 0, "m"))
    assert jobs.read_pending(spark, w.out).count() == 4
    w.answers((2, "S", 3, ANSWER))  # with the events
    assert w.stored() == [("S", 1, "High"), ("S", 2, "High")] and w.blocked() == ["8.8.8.8", "9.9.9.9"]
    w.answers((3, "S", 9, LOW), (1, "S", 99, LOW), (2, "S", 99, LOW))  # later; and to finished events
    assert w.stored() == [("S", 1, "High"), ("S", 2, "High"), ("S", 3, "Low")]
    w.events((1, "S", "4624", 0, "8.8.8.8"), (9, "S", "4624", 5, "7.7.7.7"))  # one read again, one whose answer waits
    assert {(r.log_source, r.record_id) for r in jobs.read_pending(spark, w.out).collect()} == {("T", 1), ("S", 9)}
    jobs.expire_pending(spark, w.out, "end", before=START + dt.timedelta(seconds=3))
    assert ("T", 1, "Medium") in w.stored() and jobs.read_pending(spark, w.out).count() == 1
    w.answers((1, "T", 50, ANSWER))  # the event has timed out; the one that waits meets its answer
    assert w.stored() == [("S", 1, "High"), ("S", 2, "High"), ("S", 3, "Low"), ("S", 9, "High"), ("T", 1, "Medium")]
    assert jobs.read_pending(spark, w.out).count() == 0 and w.blocked() == ["7.7.7.7", "8.8.8.8", "9.9.9.9"]


def test_time_out_in_the_answer_job(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "FAN", 1)
    w = Wait(spark, tmp_path)
    w.events((1, "S", "4624", 0, "m"), (2, "S", "4624", 1, "m"))
    w.answers((2, "S", 0, ANSWER), timeout=dt.timedelta(hours=1))
    assert w.stored() == [("S", 1, "Medium"), ("S", 2, "High")] and jobs.read_pending(spark, w.out).count() == 0
    # an answer that has waited too long for its event is none
    w.answers((3, "S", 0, ANSWER), answers_kept=dt.timedelta(0))
    w.events((3, "S", "4624", 2, "m"))
    w.answers((4, "S", 0, LOW), answers_kept=dt.timedelta(0))
    assert {r.record_id for r in jobs.read_pending(spark, w.out).collect()} == {3}


def test_block_list_of_several_writers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "FAN", 2)
    out = str(tmp_path)
    ips = lambda *x: spark.createDataFrame([(i, START) for i in x], "ip string, event_time timestamp")
    assert jobs.read_blocks(spark, out).count() == 0
    scored = lambda *x: spark.createDataFrame([(START, "High", [i]) for i in x], "event_time timestamp, final_risk_raw string, public_ips array<string>")
    monkeypatch.setattr(jobs, "stored_rows", lambda df: df)
    monkeypatch.setattr(jobs.logs, "append_batch", lambda *a: None)
    blocked = lambda: sorted(r.ip for r in jobs.read_blocks(spark, out).collect())
    jobs._finish(scored("8.8.8.8", "9.9.9.9"), out, "one", 0)
    jobs.block(ips("7.7.7.7", "10.0.0.1", "nonsense", "8.8.8.8"), out)
    assert blocked() == ["7.7.7.7", "8.8.8.8", "9.9.9.9"]
    jobs.release(ips("8.8.8.8", "7.7.7.7"), out)
    assert blocked() == ["9.9.9.9"]
    for _ in range(2):  # a repeated attempt
        jobs._finish(scored("8.8.8.8", "9.9.9.9"), out, "two", 0)
    jobs._finish(scored("9.9.9.9"), out, "one", 1)
    assert blocked() == ["8.8.8.8", "9.9.9.9"]
    jobs.release(ips("9.9.9.9"), out)
    assert blocked() == ["8.8.8.8"]
    assert {r.ip: r.events for r in jobs.read_blocks(spark, out).collect()} == {"8.8.8.8": 1}
    table = jobs._blocks_of(spark, out, jobs.BY_HAND)
    assert table.next_batch() == 3 and len(table.parts()) <= 2


def test_positions_counted_strictly_in_a_stream(spark, tmp_path):
    inserts = [""] + [f"v{i}" for i in range(1, 21)]
    row = (None, 1, "Sysmon", "1", START, "m", inserts, None)
    spark.createDataFrame([row], schemas.RAW_EVENT).write.parquet(str(tmp_path / "in"))
    found = {}
    for strict in (False, True):
        out = str(tmp_path / f"out{strict}")
        rule = rule_from_dict({"id": "r", "conditions": {"image_regex": "^v4$"}})
        jobs.detect_stream(ev.stream_channel(spark, str(tmp_path / "in")), [rule], out, available_now=True, positional_strict=strict).awaitTermination()
        found[strict] = spark.read.parquet(f"{out}/detections").first().detection
    assert found[False] is None and found[True].rule_id == "r"


def test_cut_tables_of_a_stream_are_gone(spark, tmp_path):
    from pathlib import Path

    cuts = Path(shared_dir(spark).removeprefix("file:")) / "cut"
    before = set(cuts.iterdir()) if cuts.exists() else set()
    src = str(tmp_path / "in")
    simple(spark, (1, "S", "4625", 0, "8.8.8.8")).write.parquet(src)
    jobs.process_stream(ev.stream_channel(spark, src), RULES, None, str(tmp_path / "out"), available_now=True).awaitTermination()
    assert (set(cuts.iterdir()) if cuts.exists() else set()) <= before


def test_distinct_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "S", "1", 0, "m"), (2, "S", "1", 5, "m")], [(2, "S", "1", 5, "m"), (1, "T", "1", 0, "m")], [(3, "S", "1", -9000, "m")]):
        simple(spark, *rows).coalesce(1).write.mode("append").parquet(src)
        jobs.distinct_stream(ev.stream_channel(spark, src), out, available_now=True).awaitTermination()
    got = sorted((r.log_source, r.record_id) for r in spark.read.parquet(f"{out}/events").collect())
    assert got == [("S", 1), ("S", 2), ("T", 1)]
    assert [r.record_id for r in spark.read.parquet(f"{out}/late").collect()] == [3]



def test_rollups_equal_the_reports(spark, tmp_path, monkeypatch):
    """Kept by what each micro-batch stores, over merges; a repeated attempt counts once."""
    from wardlake.operators import reports

    monkeypatch.setattr(parts, "FAN", 2)
    monkeypatch.setattr(jobs, "new_blocks", lambda scored, before: spark.createDataFrame([], jobs.BLOCKS).drop("state", "added_at"))
    out = str(tmp_path)
    schema = "host string, log_source string, record_id long, event_time timestamp, event_id string, message string, final_analysis string, final_risk string, final_risk_raw string, detection struct<mitre_technique:string>, public_ips array<string>"
    rows = [(None, "S", i, START + dt.timedelta(minutes=7 * i), "1", "m", "a", "High", ("High", "Düşük", None)[i % 3], (("T1, T2", None, "T2")[i % 3],), []) for i in range(20)]
    for k, some in enumerate((rows[:7], rows[7:8], rows[8:15])):
        for _ in range(1 + k % 2):
            jobs._finish(spark.createDataFrame(some, schema), out, "one", k, rollups=True)
    jobs._finish(spark.createDataFrame(rows[15:], schema), out, "two", 0, rollups=True)
    got = sorted(map(tuple, jobs.read_rollups(spark, out).collect()))
    stored = store.read_table(spark, f"{out}/logs")
    assert stored.count() == 20 and got == sorted(map(tuple, jobs.rollup(stored).collect()))
    assert {r.technique: r.log_count for r in reports.technique_counts(stored).collect()} == {v: n for r, v, n in got if r == "technique"} == {"T1": 7, "T2": 13}
    assert jobs._rollup_of(spark, out, "one").parts() == [(0, 1), (2, 2)]
