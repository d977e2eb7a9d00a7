"""Events against rules: first match, all matches, threshold alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlake.operators import counting, rule_index
from wardlake.operators.rules import (
    RESULT_DDL,
    Rule,
    by_file,
    by_severity,
    check_patterns,
    disjoint,
    predicate,
    result_struct,
    threshold_key,
)
from wardlake.schemas import RECORD
from wardlake.session import cut_lineage

#: Above this many rules the tests are split by event id, so that a row meets
#: only the patterns that can apply to it.
SPLIT_ABOVE = 8
_COUNTING = ("_rule", "_key", "_window_us", "_threshold", "_fired")


def _first_of(numbered: list[tuple[int, Rule]], strict: bool) -> Column:
    """Number of the first rule in the list whose predicate holds."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(numbered):
        out = F.when(predicate(rule, strict), number).otherwise(out)
    return out


def _first_number(numbered: list[tuple[int, Rule]], strict: bool) -> Column:
    if len(numbered) <= SPLIT_ABOVE:
        return _first_of(numbered, strict)
    any_id = [(n, r) for n, r in numbered if not r.event_id]
    out = _first_of(any_id, strict)
    for event_id in sorted({r.event_id for _, r in numbered if r.event_id}):
        own = [(n, r) for n, r in numbered if r.event_id in (None, event_id)]
        out = F.when(F.col("event_id") == event_id, _first_of(own, strict)).otherwise(out)
    return out


def _levels(counted: list[tuple[int, Rule]]) -> list[list[tuple[int, Rule]]]:
    """Threshold rules in groups: no event passes two rules of one group, and a
    rule comes in a later group than every earlier rule it may share events with."""
    depth: dict[int, int] = {}
    for number, rule in counted:
        before = [depth[n] for n, r in counted if n < number and not disjoint(r, rule)]
        depth[number] = 1 + max(before, default=0)
    return [
        [(n, r) for n, r in counted if depth[n] == d] for d in range(1, max(depth.values()) + 1)
    ]


def _limit(level: list[tuple[int, Rule]], value, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for number, rule in level:
        out = F.when(F.col("_rule") == number, F.lit(value(rule))).otherwise(out)
    return out


def _rule_and_key(number: int, rule: Rule) -> Column:
    return F.struct(F.lit(number).alias("rule"), threshold_key(rule).alias("key"))


def _entry(level: list[tuple[int, Rule]], first: Column, strict: bool) -> Column:
    """``(rule, key)`` of the one rule of the level an event is a candidate for.

    A rule behind ``first``, the first single-event rule that holds, is no
    candidate any more.
    """
    out = F.lit(None).cast("struct<rule:int,key:string>")
    for number, rule in level:
        test = predicate(rule, strict) & (first.isNull() | (first > number))
        out = F.when(test, _rule_and_key(number, rule)).otherwise(out)
    return out


def _entries(counted: list[tuple[int, Rule]], strict: bool) -> Column:
    """``(rule, key)`` of every threshold rule an event is a candidate for."""
    tests = [F.when(predicate(r, strict), _rule_and_key(n, r)) for n, r in counted]
    return F.array_compact(F.array(*tests))


def _candidates(rows: DataFrame, counted: list[tuple[int, Rule]], *keep: str) -> DataFrame:
    """One row per event and threshold rule it is a candidate for, ready for counting."""
    each = rows.select("_us", "_seq", F.explode("_f.entries").alias("_e"), *keep)
    return _with_limits(
        each.select("_us", "_seq", *keep, F.col("_e.rule").alias("_rule"), F.col("_e.key").alias("_key")),
        counted,
    )


def _with_limits(rows: DataFrame, counted: list[tuple[int, Rule]]) -> DataFrame:
    return rows.withColumn(
        "_window_us", _limit(counted, lambda r: r.time_window * 1_000_000, "long")
    ).withColumn("_threshold", _limit(counted, lambda r: r.threshold, "int"))


def _with_facts(events: DataFrame, **facts: Column) -> DataFrame:
    """Add ``_f``, a struct of everything the rules say about one event alone.

    It is produced by a one-element explode: filters on it stay above it, so
    the rule tests run once per row instead of being copied into each filter.
    """
    named = [value.alias(name) for name, value in facts.items()]
    return events.withColumn("_f", F.explode(F.array(F.struct(*named))))


def _with_rule(rows: DataFrame, depth: int, level: list[tuple[int, Rule]], free: Column) -> DataFrame:
    """Put the candidate rule of one level, its key and limits into the counting columns."""
    entry = F.col(f"level{depth}")
    entered = rows.withColumn("_rule", F.when(free, entry["rule"])).withColumn(
        "_key", F.when(free, entry["key"])
    )
    return _with_limits(entered, level)


def _with_order(rows: DataFrame) -> DataFrame:
    """Event order: time, then channel, record number and host."""
    return rows.withColumn("_us", counting.micros(F.col("event_time"))).withColumn(
        "_seq", F.struct("log_source", "record_id", "host")
    )


def with_host(events: DataFrame) -> DataFrame:
    """Events of a single host may come without the column."""
    return events if "host" in events.columns else events.withColumn("host", F.lit(None).cast("string"))


def join_record(events: DataFrame, narrow: DataFrame, how: str = "left") -> DataFrame:
    """Join of ``narrow``, for a left join one row per record, by the whole record key; its parts may be NULL."""
    named = narrow.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(RECORD)})
    same = F.lit(True)
    for i, c in enumerate(RECORD):
        same = same & events[c].eqNullSafe(named[f"_k{i}"])
    return events.join(named, same, how).drop(*[f"_k{i}" for i in range(len(RECORD))])


def _top(level: list[tuple[int, Rule]]) -> int:
    return max(r.threshold for _, r in level)


def _may_count(counted: list[tuple[int, Rule]]) -> Column | None:
    """Equality test every candidate of a threshold rule passes, cheap enough for the scan."""
    if not all(r.event_id for _, r in counted):
        return None
    return F.coalesce(F.col("event_id").isin(*sorted({r.event_id for _, r in counted})), F.lit(False))


@dataclass(frozen=True)
class Plan:
    """Rules in the order they are tried, numbered from 1."""

    ordered: list[Rule]
    singles: list[tuple[int, Rule]]
    counted: list[tuple[int, Rule]]
    levels: list[list[tuple[int, Rule]]]

    @staticmethod
    def of(spark: SparkSession, rules: list[Rule]) -> Plan:
        ordered = by_severity(check_patterns(spark, rules))
        numbered = list(enumerate(ordered, start=1))
        counted = [(n, r) for n, r in numbered if r.counted]
        singles = [(n, r) for n, r in numbered if not r.counted]
        return Plan(ordered, singles, counted, _levels(counted) if counted else [])

    def reported(self, rows: DataFrame) -> DataFrame:
        """``detection``, the result of the rule with the number in ``number`` (NULL for none), in its place."""
        if not self.ordered:
            return rows.withColumn("detection", F.lit(None).cast(RESULT_DDL)).drop("number")
        if len(self.ordered) > rule_index.INDEX_ABOVE:
            listed = rule_index.results(rows.sparkSession, list(enumerate(self.ordered, start=1)))
            return rows.join(F.broadcast(listed.withColumnRenamed("result", "detection")), "number", "left").drop("number")
        results = F.array(*[result_struct(r) for r in self.ordered])
        found = F.when(F.col("number").isNotNull(), F.element_at(results, F.col("number")))
        return rows.withColumn("detection", found).drop("number")


def event_facts(events: DataFrame, plan: Plan, strict_fields: bool = False, **more: Column) -> DataFrame:
    """Narrow facts of the events that any rule may take or that have one of ``more`` (arrays).

    Record key, time, first single-event rule, candidate threshold rule per
    level, and ``more``. All rule tests and parses run here, once per event.
    """
    events = with_host(events)
    if len(plan.singles) > rule_index.INDEX_ABOVE:
        found = rule_index.matching_rules(events, plan.singles, strict_fields).groupBy(*RECORD).agg(F.min("number").alias("_first"))
        events, first = join_record(events, found), F.col("_first")
    else:
        first = _first_number(plan.singles, strict_fields)
    rows = _with_facts(_with_order(events), first=first, **more).withColumnRenamed("_f", "_s")
    levels = {f"level{d}": _entry(lv, F.col("_s.first"), strict_fields) for d, lv in enumerate(plan.levels, 1)}
    if levels:
        rows = _with_facts(rows, **levels)
    named = [F.col(f"_s.{c}").alias(c) for c in ("first", *more)]
    kept = rows.select(*RECORD, "_us", "_seq", *named, *[F.col("_f")[c].alias(c) for c in levels])
    useful = F.col("first").isNotNull()
    for c in levels:
        useful = useful | F.col(c).isNotNull()
    for c in more:
        useful = useful | (F.size(c) > 0)
    return kept.filter(useful)


def rule_numbers(facts: DataFrame, plan: Plan) -> DataFrame:
    """Record key and ``number`` of the rule that takes each event, for written ``facts``.

    A level of threshold rules needs the outcome of the one before twice, so
    these narrow rows are written between levels.
    """
    rows = facts.select(*RECORD, "_us", "_seq", "first", *[f"level{d}" for d in range(1, len(plan.levels) + 1)])
    taken = rows.filter(F.col("first").isNotNull()).select(*RECORD, F.col("first").alias("number"))
    if plan.levels:
        open_rows = F.lit(False)
        for d in range(1, len(plan.levels) + 1):
            open_rows = open_rows | F.col(f"level{d}").isNotNull()
        rows = rows.filter(open_rows).withColumn("_before", F.lit(None).cast("int"))
        for depth, level in enumerate(plan.levels, start=1):
            rows = _mark_level(rows, depth, level, F.col("_before").isNull())
            rows = rows.withColumn("_before", F.coalesce("_before", "_won")).drop("_won")
            if depth < len(plan.levels):
                rows = cut_lineage(rows)
        won = rows.filter(F.col("_before").isNotNull()).select(*RECORD, F.col("_before").alias("number"))
        taken = taken.unionByName(won)
    return taken.groupBy(*RECORD).agg(F.min("number").alias("number"))


def first_match(events: DataFrame, rules: list[Rule], strict_fields: bool = False) -> DataFrame:
    """Add ``detection``: the first rule that matches each event, NULL when none does.

    Rules are tried by severity, then file, then place in the file. A threshold
    rule counts only the events no earlier rule took. Events need ``record_id,
    log_source, event_id, event_time, message, details``, and ``host`` where
    there is more than one. A record given more than once counts once; every
    row comes back, with the same outcome.
    """
    plan = Plan.of(events.sparkSession, rules)
    if not plan.counted and len(plan.singles) <= rule_index.INDEX_ABOVE:
        rows = _with_facts(events, first=_first_number(plan.singles, strict_fields))
        return plan.reported(rows.withColumn("number", F.col("_f.first"))).drop("_f")
    facts = cut_lineage(event_facts(events, plan, strict_fields))
    joined = join_record(with_host(events), rule_numbers(facts, plan))
    return plan.reported(joined).select(*events.columns, "detection")


def _mark_level(rows: DataFrame, depth: int, level: list[tuple[int, Rule]], free: Column) -> DataFrame:
    """Add ``_won``: the rule of this level that fires on the row."""
    marked = counting.mark_fired(_with_rule(rows, depth, level, free), _top(level))
    return marked.withColumn("_won", F.when(F.col("_fired"), F.col("_rule"))).drop(*_COUNTING)


def all_matches(events: DataFrame, rules: list[Rule], strict_fields: bool = False) -> DataFrame:
    """Add ``detections``: every matching rule in load order; each rule sees every event.

    With threshold rules the rule tests run once: their narrow outcome is written,
    counted, and joined back by record.
    """
    ordered = by_file(check_patterns(events.sparkSession, rules))
    given, events = events.columns, with_host(events)
    if not ordered:
        return events.select(given).withColumn("detections", F.array().cast(f"array<{RESULT_DDL}>"))
    numbered = list(enumerate(ordered, start=1))
    singles = [(n, r) for n, r in numbered if not r.counted]
    counted = [(n, r) for n, r in numbered if r.counted]
    if len(numbered) > rule_index.INDEX_ABOVE:
        return join_record(events, _indexed_matches(events, numbered, strict_fields)).select(
            *given, F.coalesce("detections", F.array().cast(f"array<{RESULT_DDL}>")).alias("detections")
        )
    results = F.array(*[result_struct(r) for r in ordered])
    tests = [F.when(predicate(r, strict_fields), F.lit(n)) for n, r in singles]
    none = F.array().cast("array<int>")
    facts = {"numbers": F.array_compact(F.array(*tests)) if tests else none}
    if not counted:
        rows = _with_facts(events, **facts).withColumn("_numbers", F.col("_f.numbers"))
    else:
        narrow = _narrow(events, entries=_entries(counted, strict_fields), **facts)
        fired = counting.fired_rows(_candidates(narrow, counted, *RECORD), _top(counted))
        hits = fired.select(*RECORD, F.array("_rule").alias("_numbers")).unionByName(narrow.select(*RECORD, F.col("_f.numbers").alias("_numbers")))
        hits = hits.groupBy(*RECORD).agg(F.array_distinct(F.flatten(F.collect_set("_numbers"))).alias("_numbers"))
        rows = join_record(events, hits).withColumn("_numbers", F.coalesce("_numbers", none))
    return rows.withColumn(
        "detections",
        F.transform(F.array_sort("_numbers"), lambda n: F.element_at(results, n)),
    ).select(*given, "detections")


def _indexed_matches(events: DataFrame, numbered: list[tuple[int, Rule]], strict: bool) -> DataFrame:
    """Record key and ``detections`` of the events any rule of a large catalogue matches."""
    spark = events.sparkSession
    keyed = _with_order(events).withColumn("_keys", F.array(*[threshold_key(Rule("", **w)) for w in KEY_KINDS]))
    found = rule_index.matching_rules(keyed, numbered, strict, ("_us", "_seq", "_keys"))
    found = cut_lineage(found.dropDuplicates([*RECORD, "number"]))
    singles = found.filter("threshold = 0").select(*RECORD, "number")
    counted = [r.threshold for _, r in numbered if r.counted]
    if counted:
        key = F.element_at("_keys", F.col("kind"))
        rows = found.filter("threshold > 0").select(
            *RECORD, "_us", "_seq", F.col("number").alias("_rule"), key.alias("_key"),
            F.col("window_us").alias("_window_us"), F.col("threshold").alias("_threshold"),
        )
        fired = counting.fired_rows(rows, max(counted)).select(*RECORD, F.col("_rule").alias("number"))
        singles = singles.unionByName(fired)
    named = singles.join(F.broadcast(rule_index.results(spark, numbered)), "number")
    listed = named.groupBy(*RECORD).agg(F.array_sort(F.collect_list(F.struct("number", "result"))).alias("_d"))
    return listed.select(*RECORD, F.col("_d.result").alias("detections"))


#: A rule of each kind of counting key.
KEY_KINDS = ({}, {"image_regex": "x"}, {"parent_image_regex": "x"})


def _narrow(events: DataFrame, **facts: Column) -> DataFrame:
    """Record key, order and ``_f`` (arrays) of the events for which any of it is not empty, written once."""
    rows = _with_order(_with_facts(events, **facts)).select(*RECORD, "_us", "_seq", "_f")
    useful = F.lit(False)
    for name in facts:
        useful = useful | (F.size(f"_f.{name}") > 0)
    return cut_lineage(rows.filter(useful))


def pick_first(matches: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``detection``: of the rules in ``detections``, the one that ranks first.

    The choice is made inside the array, so no rows move. Without threshold
    rules it equals ``first_match``.
    """
    place = {r.id: i for i, r in enumerate(by_severity(rules))}
    def ranked(d: Column) -> Column:
        out = F.lit(len(place))
        for rule_id, position in place.items():
            out = F.when(d["rule_id"] == rule_id, position).otherwise(out)
        return F.struct(out.alias("place"), d.alias("result"))

    return matches.withColumn(
        "detection", F.array_min(F.transform("detections", ranked))["result"]
    )


def threshold_alerts(events: DataFrame, rules: list[Rule], strict_fields: bool = False) -> DataFrame:
    """One row per event and threshold rule that fires, each rule on its own.

    The rule tests run once, and only narrow rows of the events a rule counts
    are shuffled; those that fire meet the events by record.
    """
    ordered = by_file(check_patterns(events.sparkSession, rules))
    numbered = [(n, r) for n, r in enumerate(ordered, start=1) if r.counted]
    given, events = events.columns, with_host(events)
    results = F.array(*[result_struct(r) for r in ordered])
    cheap = _may_count(numbered)
    rows = events if cheap is None else events.filter(cheap)
    narrow = _narrow(rows, entries=_entries(numbered, strict_fields))
    fired = counting.fired_rows(_candidates(narrow, numbered, *RECORD), _top(numbered))
    fired = fired.select(*RECORD, "_rule", "_key").distinct()
    return join_record(rows, fired, "inner").select(
        *given,
        F.col("_key").alias("threshold_key"),
        F.element_at(results, F.col("_rule")).alias("detection"),
    )


def with_threshold_key(events: DataFrame, rule: Rule, name: str = "threshold_key") -> DataFrame:
    """Add the key a threshold rule counts by."""
    return events.withColumn(name, threshold_key(rule))
