"""Event rows for tests, and the rule semantics replayed one event at a time."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import types as T

from wardlake import schemas
from wardlake.operators.rules import UNKNOWN, Rule

START = dt.datetime(2024, 1, 1)

PREPARED = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("log_source", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("message", T.StringType()),
        T.StructField("details", schemas.PROCESS_DETAILS),
    ]
)


def details(image=None, command=None, user=None, parent=None, pid=None):
    return (image, command, user, parent, pid)


def event(rid, seconds, event_id="4625", source="Security", message="text", det=None):
    return (rid, source, event_id, START + dt.timedelta(seconds=seconds), message, det)


def frame(spark, rows):
    return spark.createDataFrame(rows, PREPARED)


def _key(rule: Rule, event_id, det):
    if det is not None and rule.parent_image_regex:
        return f"{event_id}:{det[3] or UNKNOWN}->{det[0] or UNKNOWN}"
    if det is not None and rule.image_regex:
        return f"{event_id}:{det[0] or UNKNOWN}"
    return event_id


def replay(rows, rules: list[Rule], first: bool) -> dict[int, list[str]]:
    """Rule ids per record: lists of times per key, old ones dropped, one event after the other."""
    seen: dict[tuple[str, str], list] = {}
    out: dict[int, list[str]] = {}
    for rid, source, event_id, at, message, det in sorted(rows, key=lambda r: (r[3], r[1], r[0])):
        matched = out.setdefault(rid, [])
        for rule in rules:
            if rule.provider and rule.provider.lower() != source.lower():
                continue
            if rule.event_id and rule.event_id != event_id:
                continue
            if rule.message_regex and not re.search(rule.message_regex, message, re.I | re.M):
                continue
            tests = ((rule.image_regex, 0), (rule.command_line_regex, 1), (rule.parent_image_regex, 3))
            if det is not None and any(
                p and det[i] is not None and not re.search(p, det[i], re.I) for p, i in tests
            ):
                continue
            if rule.counted:
                times = seen.setdefault((rule.id, _key(rule, event_id, det)), [])
                oldest = at - dt.timedelta(seconds=rule.time_window)
                times[:] = [t for t in times if t > oldest] + [at]
                if len(times) < rule.threshold:
                    continue
            matched.append(rule.id)
            if first:
                break
    return out
