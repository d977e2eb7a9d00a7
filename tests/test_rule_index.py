"""Large catalogues: the index of required pieces gives what each rule's own predicate gives."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from replay import details, event, frame, replay
from wardlake.operators import detect, rule_index
from wardlake.operators.rules import by_file, by_severity, check_patterns, rule_from_dict

PIECES = ("fail", "Admin", "log on", "a.b", "ſet", "kelvin", "x", "")


def random_rule(rng, i):
    part = lambda: re.escape(rng.choice(PIECES))
    forms = (
        lambda: part() + r".*" + part(), lambda: f"({part()}|{part()})", lambda: f"(?:{part()})?{part()}", lambda: rf"^\s*{part()}+$",
        lambda: f"[fk]{part()}", lambda: f"(?={part()}).", lambda: "(unclosed", lambda: f"(?:{part()}|x{part()}){{2}}", lambda: f"(?i:{part()})",
    )
    where = {"event_id": rng.choice((None, "1", "2"))}
    for name in ("message_regex", "image_regex", "command_line_regex", "parent_image_regex"):
        if rng.random() < 0.4:
            where[name] = rng.choice(forms)()
    if rng.random() < 0.3:
        where["provider"] = rng.choice(("s", "T"))
    if rng.random() < 0.3:
        where |= {"threshold": rng.randint(1, 3), "time_window": rng.randint(1, 60)}
    users = {"exclude_users": ["bob"]} if rng.random() < 0.2 else {"include_users": ["Eve"]} if rng.random() < 0.2 else {}
    return rule_from_dict({"id": f"r{i}", "severity": rng.choice(("low", "high", "critical")), "conditions": where, "filters": users}, "a", i)


def random_events(rng, n):
    text = lambda: " ".join(rng.choice((*PIECES, "SET", "İx", "Kelvin", "user bob", "user EVE", "ADMIN")) for _ in range(rng.randint(0, 4)))
    some = lambda: rng.choice((None, text(), text()))
    rows = []
    for i in range(n):
        det = details(some(), some(), None, some()) if rng.random() < 0.7 else None
        rows.append(event(i, 3 * i, rng.choice("12"), rng.choice("ST"), text(), det))
    return rows


@pytest.mark.parametrize("strict", [False, True])
def test_index_equals_predicates(spark, monkeypatch, strict):
    rng = random.Random(11 + strict)
    rules = [random_rule(rng, i) for i in range(30)]
    events = frame(spark, random_events(rng, 80)).repartition(3)
    ids = lambda df: {r.record_id: r.ids for r in df.select("record_id", F.transform("detections", lambda d: d["rule_id"]).alias("ids")).collect()}
    direct = ids(detect.all_matches(events, rules, strict))
    singles = [r for r in rules if not r.counted]
    first = lambda chosen: {r.record_id: r.detection for r in detect.first_match(events, chosen, strict).collect()}
    direct_first = first(singles)
    monkeypatch.setattr(rule_index, "INDEX_ABOVE", 0)
    assert ids(detect.all_matches(events, rules, strict)) == direct
    assert sum(map(len, direct.values())) > 30
    assert first(singles) == direct_first


def test_first_match_with_rules_that_count(spark, monkeypatch):
    rng = random.Random(3)
    rules = [r for r in (random_rule(rng, i) for i in range(40)) if not r.counted]
    rules += [rule_from_dict({"id": f"c{i}", "severity": "critical", "conditions": {"event_id": str(i), "threshold": 2, "time_window": 30}}, "A", i) for i in (1, 2)]
    events = frame(spark, random_events(rng, 60))
    found = lambda: {r.record_id: r.detection for r in detect.first_match(events, rules).collect()}
    direct = found()
    monkeypatch.setattr(rule_index, "INDEX_ABOVE", 0)
    assert found() == direct and any(d and d.rule_id.startswith("c") for d in direct.values())


def test_replay_through_the_index(spark, monkeypatch):
    monkeypatch.setattr(rule_index, "INDEX_ABOVE", 0)
    rules = [
        rule_from_dict({"id": "a", "conditions": {"message_regex": "fail", "threshold": 2, "time_window": 10}}, "x", 0),
        rule_from_dict({"id": "b", "conditions": {"event_id": 1}}, "x", 1),
        rule_from_dict({"id": "off", "enabled": False}, "x", 2),
    ]
    rows = [event(i, 4 * i, "12"[i % 2], "S", ("fail", "FAILED", "no")[i % 3]) for i in range(20)]
    got = {r.record_id: [d.rule_id for d in r.detections] for r in detect.all_matches(frame(spark, rows), rules).collect()}
    assert got == replay(rows, by_file(rules), False)
    repeated = frame(spark, rows).unionByName(frame(spark, rows[:7]))
    again = detect.all_matches(repeated, rules).collect()
    assert len(again) == 27 and all([d.rule_id for d in r.detections] == got[r.record_id] for r in again)


def test_required_pieces():
    need = rule_index.required_texts
    assert need(r"abc\s+defg") == [["abc"], ["defg"]]
    assert need("foobar|barfoo") == [["barfoo", "foobar"]]
    assert need("foobar|x") == [] and need("(?:foobar)?") == [] and need("(broken") == [] and need("") == []
    assert need("(?:foobar){2,}Z") == [["foobar"]] and need("f[o]o") == [["foo"]] or need("f[o]o") == []
    rng = random.Random(1)
    for i in range(300):
        rule = random_rule(rng, i)
        for text in [t for t in (rule.message_regex,) if t and t != "(unclosed"]:
            for _ in range(20):
                subject = "".join(rng.choice(PIECES[:4] + (" ", "x")) for _ in range(5))
                if re.search(text, subject, re.I):
                    assert all(any(t in subject.lower() for t in texts) for texts in need(text)), (text, subject)


def test_only_trigrams_that_may_be_indexed_are_looked_up(spark):
    """A text's keys hold every indexed trigram in it, overlapping ones and those across lines too, and few others."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab1.^]\\-\n é😀") for _ in range(400)) for _ in range(20)] + ["ab", ""]
    indexed = {"1.1", "ab1", "^]-", "\\a\n", "b1."}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    for r in rows.select("t", rule_index._grams_of(2, F.col("t"), indexed).alias("g"), rule_index._grams_of(2, F.col("t"), set()).alias("n")).collect():
        if r.t is None:
            assert r.g == r.n == ["2:"]
            continue
        every = {r.t[i : i + 3] for i in range(len(r.t) - 2)}
        got = [g[2:] for g in r.g]
        assert r.n == [] and len(got) == len(set(got)) and all(g.startswith("2:") for g in r.g)
        assert indexed & every <= set(got) <= every and (len(every) < 50 or len(got) < len(every) / 4)


def test_plan_does_not_grow_with_the_catalogue(spark):
    events = frame(spark, random_events(random.Random(1), 5))
    rules = lambda n: [rule_from_dict({"id": f"r{i}", "conditions": {"message_regex": f"piece {i}x"}}, "a", i) for i in range(n)]
    size = lambda n: len(rule_index.matching_rules(detect.with_host(events), list(enumerate(check_patterns(spark, rules(n)), 1)))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(300) - size(3000)) < 300
    assert by_severity(rules(3))[0].id == "r0"
