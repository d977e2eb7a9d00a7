"""Raw events to stored rows and block-list additions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlake.functions.text import STORED_MESSAGE_CHARS, context_text, event_message
from wardlake.operators.detect import Plan, event_facts, join_record, rule_numbers, with_host
from wardlake.operators.enrich import (
    FALLBACK_RISK,
    fallback_answer,
    last_answers,
    prompts,
    threat_table,
    with_ips,
)
from wardlake.operators.fuse import fuse
from wardlake.operators.respond import new_blocks
from wardlake.operators.rules import Rule
from wardlake.schemas import RECORD
from wardlake.session import cut_lineage
from wardlake.sources.events import prepare

NO_ANSWER = "AI Error: no analysis available"
ANSWER_DDL = "struct<analysis:string,analysis_risk:string,reason:string>"
THREAT_DDL = "struct<ip:string,category:string,confidence:int>"


def record_facts(raw: DataFrame, plan: Plan, strict_fields: bool = False, positional_strict: bool = False) -> DataFrame:
    """Narrow facts of every event that matters to a rule or names a public address, written once.

    This is the only place where events are parsed: details, rule tests and
    addresses are read off here, and everything later works on these rows.
    """
    prepared = with_ips(prepare(with_host(raw), positional_strict))
    return cut_lineage(event_facts(prepared, plan, strict_fields, public_ips=F.col("public_ips")))


def scored_from(
    raw: DataFrame,
    plan: Plan,
    numbers: DataFrame,
    facts: DataFrame,
    feed: DataFrame | None,
    answers: DataFrame | None,
) -> DataFrame:
    """The events with everything found about them, by one wide join.

    Rule, feed hit, addresses and answer are brought together on narrow rows
    first. ``answers`` are parsed ones.
    """
    none = {"number": "int", "threat": THREAT_DDL, "public_ips": "array<string>", "answer": ANSWER_DDL}

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select(*RECORD, *[F.col(c) if c == name else F.lit(None).cast(t).alias(c) for c, t in none.items()])

    found = part(numbers, "number").unionByName(part(facts.filter(F.size("public_ips") > 0), "public_ips"))
    if feed is not None:
        found = found.unionByName(part(threat_table(facts, feed), "threat"))
    if answers is not None:
        found = found.unionByName(part(last_answers(answers), "answer"))
    merged = found.groupBy(*RECORD).agg(*[F.first(c, ignorenulls=True).alias(c) for c in none])
    message = event_message(F.col("message"), F.col("inserts"))
    events = join_record(with_host(raw).withColumn("message", message), merged)
    events = events.withColumn(
        "public_ips", F.coalesce("public_ips", F.array().cast("array<string>"))
    )
    return _fused(plan.reported(events))


def _fused(events: DataFrame) -> DataFrame:
    """Analysis, risk and final text from ``answer``, which may be NULL or unusable."""
    missing = fallback_answer(F.col("event_id"), F.coalesce("answer.reason", F.lit(NO_ANSWER)))
    usable = F.col("answer").isNotNull() & F.col("answer.reason").isNull()
    return fuse(
        events.withColumn("analysis", F.when(usable, F.col("answer.analysis")).otherwise(missing))
        .withColumn("analysis_risk", F.coalesce("answer.analysis_risk", F.lit(FALLBACK_RISK)))
        .drop("answer")
    )


def rescored(waiting: DataFrame, answers: DataFrame | None, answered_only: bool = False, last: bool = False) -> DataFrame:
    """Events with their detection, feed hit and addresses, fused with (parsed) answers that came later.

    With ``last``, ``answers`` are the last ones of each record already.
    """
    if answers is None:
        return _fused(waiting.withColumn("answer", F.lit(None).cast(ANSWER_DDL)))
    joined = join_record(waiting, answers if last else last_answers(answers))
    return _fused(joined.filter(F.col("answer").isNotNull()) if answered_only else joined)


def with_context(prepared: DataFrame) -> DataFrame:
    """Add the full event text."""
    text = context_text(
        F.col("log_source"), F.col("event_id"), F.col("event_time"), F.col("combined_text")
    )
    return prepared.withColumn("context_text", text)


def scored_events(
    raw: DataFrame,
    rules: list[Rule],
    feed: DataFrame | None,
    answers: DataFrame | None = None,
    strict_fields: bool = False,
    positional_strict: bool = False,
) -> DataFrame:
    """Every event with feed hit, detection, final risk and final text.

    ``answers`` are parsed ones. A record given more than once gets the same
    outcome on every row.
    """
    plan = Plan.of(raw.sparkSession, rules)
    facts = record_facts(raw, plan, strict_fields, positional_strict)
    return scored_from(raw, plan, rule_numbers(facts, plan), facts, feed, answers)


def prompt_rows(raw: DataFrame, knowledge: DataFrame) -> DataFrame:
    """What an external scorer is asked about each event, with what is known about its event id."""
    return prompts(with_context(prepare(with_host(raw))), knowledge)


def stored_rows(scored: DataFrame) -> DataFrame:
    """Scored events as rows of the log table."""
    return scored.select(
        "host",
        "log_source",
        F.col("record_id").alias("id"),
        F.date_trunc("second", "event_time").alias("timestamp"),
        "event_id",
        F.left("message", F.lit(STORED_MESSAGE_CHARS)).alias("message"),
        F.col("final_analysis").alias("ai_analysis"),
        F.col("final_risk").alias("risk_score"),
        F.col("final_risk_raw").alias("risk_score_raw"),
        F.col("detection.mitre_technique").alias("mitre_technique"),
    )


def process_events(
    raw: DataFrame,
    rules: list[Rule],
    feed: DataFrame,
    answers: DataFrame | None,
    blocked: DataFrame,
    strict_fields: bool = False,
    positional_strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(rows to store, block-list rows to add)."""
    scored = scored_events(raw, rules, feed, answers, strict_fields, positional_strict)
    return stored_rows(scored), new_blocks(scored, blocked)
