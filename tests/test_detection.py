import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from replay import details, event, frame, replay
from wardlake.operators import counting, detect
from wardlake.operators.rules import (
    by_file,
    by_severity,
    catalogue_counts,
    check_patterns,
    load_rules,
    predicate,
    rule_from_dict,
    rules_frame,
    threshold_key,
)


def rule(rid="r", rule_file="a.yaml", idx=0, severity="high", **where):
    data = {"id": rid, "severity": severity, "conditions": where}
    return rule_from_dict(data, rule_file, idx)


def first(spark, rows, rules, **kw):
    out = detect.first_match(frame(spark, rows), rules, **kw)
    return {r[0]: r[1] for r in out.select("record_id", "detection.rule_id").collect()}


def every(spark, rows, rules):
    ids = F.transform("detections", lambda d: d["rule_id"]).alias("ids")
    out = detect.all_matches(frame(spark, rows), rules).select("record_id", ids)
    return {r[0]: r[1] for r in out.collect()}


def test_repeated_records_count_once_and_agree(spark):
    rows = [event(i, 10 * i) for i in range(4)] + [event(9, 35, "4624")]
    rules = [rule("t", event_id="4625", threshold=3), rule("s", severity="low", event_id="4624")]
    for given in (rows + rows[1:3], rows + rows):
        df = frame(spark, given)
        out = detect.first_match(df, rules).select("record_id", "detection.rule_id").collect()
        assert len(out) == len(given)
        assert {tuple(r) for r in out} == {(0, None), (1, None), (2, "t"), (3, "t"), (9, "s")}
        many = detect.all_matches(df, rules)
        assert many.count() == len(given)
        ids = many.select("record_id", F.transform("detections", lambda d: d["rule_id"])).collect()
        assert {(r[0], tuple(r[1])) for r in ids} == {(0, ()), (1, ()), (2, ("t",)), (3, ("t",)), (9, ("s",))}


def test_hosts_share_record_numbers(spark):
    one = frame(spark, [event(i, 10 * i) for i in range(2)]).withColumn("host", F.lit("a"))
    two = frame(spark, [event(i, 10 * i + 5) for i in range(2)]).withColumn("host", F.lit("b"))
    out = detect.first_match(one.unionByName(two), [rule("t", event_id="4625", threshold=4)])
    got = {(r.host, r.record_id): r.rule_id for r in out.select("host", "record_id", "detection.rule_id").collect()}
    assert got == {("a", 0): None, ("b", 0): None, ("a", 1): None, ("b", 1): "t"}


def window_counts(spark, offsets, window, highest):
    """Count inside the window at each event, read from which thresholds fire."""
    rows = [event(i, s) for i, s in enumerate(offsets)]
    rules = [rule(f"t{n}", idx=n, event_id="4625", time_window=window, threshold=n) for n in range(1, highest + 1)]
    fired = every(spark, rows, rules)
    return [len(fired[i]) for i in range(len(offsets))]


def test_five_failed_logons_fire_at_the_fifth(spark):
    rows = [event(i, 10 * i) for i in range(5)]
    got = first(spark, rows, load_rules())
    assert [got[i] for i in range(5)] == [None] * 4 + ["brute_force_001"]
    assert set(first(spark, rows[:4], load_rules()).values()) == {None}


def test_keeps_firing_without_reset(spark):
    got = first(spark, [event(i, i) for i in range(8)], load_rules())
    assert [got[i] is not None for i in range(8)] == [False] * 4 + [True] * 4


def test_window_bound_is_strict(spark):
    assert window_counts(spark, [0, 11, 22, 70], 60, 4) == [1, 2, 3, 3]
    assert window_counts(spark, [0, 10, 20, 70], 60, 4) == [1, 2, 3, 2]


def test_equal_times_count_in_sequence(spark):
    offsets = [0, 11, 22, 70, 71, 72, 72, 72, 131, 132]
    assert window_counts(spark, offsets, 60, 7) == [1, 2, 3, 3, 3, 4, 5, 6, 4, 2]


def test_other_event_id_and_disabled_rule(spark):
    rows = [event(i, i, event_id="4624") for i in range(6)]
    assert set(first(spark, rows, load_rules()).values()) == {None}
    off = rule_from_dict({"id": "x", "enabled": False, "conditions": {"threshold": 1}})
    assert set(first(spark, rows, [off]).values()) == {None}


def test_shipped_process_rules(spark):
    office = details("C:\\Windows\\cmd.exe", "cmd /c", "u", "C:\\Office\\WINWORD.EXE")
    encoded = details("C:\\powershell.exe", "powershell -EncodedCommand AAA", "u", "cmd.exe")
    both = details("C:\\powershell.exe", "powershell -enc -EncodedCommand A", "u", "winword.exe")
    harmless = details("notepad.exe", "notepad", "u", "explorer.exe")
    absent = details("N/A", "N/A", "N/A", "N/A")
    rows = [
        event(i, i, "1", "Sysmon", "m", d)
        for i, d in enumerate([office, encoded, both, harmless, None, absent])
    ]
    got = every(spark, rows, load_rules())
    parent, code = "parent_child_001", "powershell_encoded_001"
    assert got == {0: [parent], 1: [code], 2: [parent, code], 3: [], 4: [parent, code], 5: []}
    # Equal severity: file name decides.
    assert first(spark, rows, load_rules())[2] == parent
    strict = first(spark, rows, load_rules(), strict_fields=True)
    assert strict[4] is None and strict[0] == parent


def test_broken_pattern_never_matches(spark):
    bad = rule("bad", message_regex="(unclosed")
    bad_image = rule("image", idx=1, image_regex="*")
    rows = [event(0, 0), event(1, 0, det=details("a.exe"))]
    assert every(spark, rows, [bad, bad_image]) == {0: ["image"], 1: []}
    checked = check_patterns(spark, [bad, bad_image, rule("ok", message_regex="(?P<n>x)")])
    assert [sorted(r.broken) for r in checked] == [["message_regex"], ["image_regex"], []]


def test_message_pattern_is_multiline_and_ignores_case(spark):
    rows = [event(0, 0, message="one\nTWO three"), event(1, 0, message="one two"), event(2, 0, message="Ünlü\n")]
    assert every(spark, rows, [rule("m", message_regex="^two")]) == {0: ["m"], 1: [], 2: []}
    assert every(spark, rows, [rule("u", message_regex=r"^\w+$")]) == {0: ["u"], 1: [], 2: ["u"]}


def test_user_filters(spark):
    rows = [event(0, 0, message="Account Name: bob"), event(1, 0, message="User Name: ANN"), event(2, 0, message="none")]
    skip = rule_from_dict({"id": "x", "filters": {"exclude_users": ["BOB"]}})
    only = rule_from_dict({"id": "i", "filters": {"include_users": ["bob"]}}, "f", 1)
    assert every(spark, rows, [skip, only]) == {0: ["i"], 1: ["x"], 2: ["x", "i"]}


def test_rule_defaults_and_old_keys():
    r = rule_from_dict({"name": "N", "mitre": "T1", "tags": "no list", "conditions": {"event_id": 7}}, "f.yaml")
    assert (r.id, r.mitre, r.tags, r.event_id, r.time_window, r.threshold) == ("rule_f.yaml", ("T1",), (), "7", 60, 0)
    assert r.match_message == "🔴 Detection Rule Match: N" and r.severity == "medium"
    assert rule_from_dict({"risk_level": "Yüksek"}).severity == "high"
    assert rule_from_dict({"risk_level": "low", "severity": "critical"}).severity == "critical"


def test_rule_files(spark, tmp_path):
    (tmp_path / "b.yaml").write_text("- {id: one}\n- {id: two, enabled: false}\n")
    (tmp_path / "a.yml").write_text("id: three\n")
    (tmp_path / "broken.yaml").write_text("id: [\n")
    (tmp_path / "empty.yaml").write_text("")
    rules = load_rules(tmp_path)
    assert [(r.id, r.idx) for r in rules] == [("one", 0), ("two", 1), ("three", 0)]
    assert load_rules(tmp_path / "missing") == []
    counts = catalogue_counts(rules_frame(spark, rules)).first()
    assert (counts["loaded"], counts["enabled"]) == (3, 2)


def test_result_reports_first_technique(spark):
    r = rule_from_dict({"id": "x", "severity": "LOW", "mitre": ["T1", "T2"], "tags": ["a"], "description": "d"})
    got = detect.first_match(frame(spark, [event(0, 0)]), [r]).select("detection.*").first()
    assert got.asDict() == {
        "rule_id": "x", "rule_name": "Unknown Rule", "risk_level": "Low", "severity": "low", "mitre_technique": "T1",
        "mitre_techniques": ["T1", "T2"], "tags": ["a"], "description": "d",
        "match_message": "🔴 Detection Rule Match: Unknown Rule",
    }


def test_many_rules_are_split_by_event_id(spark):
    rules = [rule(f"r{i}", idx=i, event_id=str(i % 5)) for i in range(12)] + [rule("any", idx=20)]
    rows = [event(i, i, event_id=str(i)) for i in range(7)]
    got = first(spark, rows, rules)
    assert [got[i] for i in range(7)] == ["r0", "r1", "r2", "r3", "r4", "any", "any"]


def test_no_rules(spark):
    assert first(spark, [event(0, 0)], []) == {0: None}
    assert every(spark, [event(0, 0)], []) == {0: []}


CHAIN = [
    rule("fine", severity="critical", event_id="1", image_regex="a|b", time_window=40, threshold=5),
    rule("coarse", idx=1, event_id="1", time_window=60, threshold=4),
    rule("logons", idx=2, event_id="4625", time_window=60, threshold=9),
    rule("single", idx=3, severity="low", event_id="1", image_regex="a"),
    rule("all", "b.yaml", severity="low", provider="sysmon", time_window=100, threshold=7),
]


def busy_rows(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        seconds = rnd.choice([rnd.randint(0, n), rnd.randint(n // 4, n // 4 + 10)])
        code = rnd.choice(["4625", "1", "1"])
        det = None
        if code == "1" and rnd.random() < 0.8:
            det = details(rnd.choice(["a.exe", "b.exe", "c.exe"]), "cmd", "u", "p.exe")
        rows.append(event(i, seconds, code, "Sysmon" if code == "1" else "Security", "m", det))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_chained_rules_equal_replay(spark, seed):
    rows = busy_rows(seed, 1500)
    want = replay(rows, by_severity(CHAIN), True)
    got = first(spark, rows, CHAIN)
    assert {i: [r] if r else [] for i, r in got.items()} == want


def test_all_matches_equal_replay(spark):
    rows = busy_rows(3, 1200)
    assert every(spark, rows, CHAIN) == replay(rows, by_file(CHAIN), False)
    alerts = detect.threshold_alerts(frame(spark, rows), CHAIN).select("record_id", "detection.rule_id")
    want = {(i, r) for i, rs in replay(rows, by_file(CHAIN), False).items() for r in rs if r != "single"}
    assert {tuple(r) for r in alerts.collect()} == want


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    offsets=st.lists(st.integers(0, 90), min_size=1, max_size=25),
    window=st.integers(1, 45),
    threshold=st.integers(1, 6),
)
def test_any_sequence_equals_replay(spark, offsets, window, threshold):
    rows = [event(i, s) for i, s in enumerate(offsets)]
    rules = [rule("t", event_id="4625", time_window=window, threshold=threshold)]
    got = {i: [r] if r else [] for i, r in first(spark, rows, rules).items()}
    assert got == replay(rows, rules, True)


def test_hot_moment_with_large_threshold(spark):
    """Thousands of events at one time; the salted limit is used above the pushdown bound."""
    n, threshold = 5000, 1200
    assert threshold > counting.RANK_LIMIT_PUSHDOWN
    rows = [event(i, 0 if i < n else 30) for i in range(n + 3)]
    got = first(spark, rows, [rule("t", event_id="4625", time_window=60, threshold=threshold)])
    assert [got[i] is not None for i in range(n + 3)] == [i >= threshold - 1 for i in range(n + 3)]


def test_ties_are_limited_before_the_shuffle(spark):
    rows = frame(spark, [event(i, 0) for i in range(10)])
    alerts = detect.threshold_alerts(rows, [rule("t", event_id="4625", threshold=3)])
    plan = alerts._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_threshold_key(spark):
    fine = rule("f", parent_image_regex="x", image_regex="y", threshold=1)
    image = rule("i", image_regex="y", threshold=1)
    plain = rule("p", threshold=1)
    rows = [event(0, 0, "1", det=details("a", None, None, "p")), event(1, 0, "1", det=details()), event(2, 0, "1")]
    got = frame(spark, rows).orderBy("record_id").select(*[threshold_key(r) for r in (fine, image, plain)])
    assert [tuple(r) for r in got.collect()] == [
        ("1:p->a", "1:a", "1"), ("1:UNKNOWN->UNKNOWN", "1:UNKNOWN", "1"), ("1", "1", "1"),
    ]


def test_predicate_is_never_null(spark):
    r = rule("n", provider="Security", event_id="1", message_regex="x", image_regex="y")
    rows = [(0, None, None, None, None, None)]
    assert frame(spark, rows).select(predicate(r)).first()[0] is False
