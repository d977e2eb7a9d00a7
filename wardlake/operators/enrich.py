"""Enrichment: threat feed, event knowledge, analysis answers, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardlake.functions import ip as ipf
from wardlake.functions.risk import answer_risk
from wardlake.functions.text import event_id_from_text, strip
from wardlake.operators.detect import join_record, with_host
from wardlake.operators.sizes import broadcast_if_small
from wardlake.schemas import RECORD

HIT_DDL = "struct<ip:string,category:string,confidence:int>"


def with_ips(events: DataFrame, text_col: str = "combined_text") -> DataFrame:
    """Add ``ips`` (all valid, in order) and ``public_ips``."""
    return events.withColumn("ips", ipf.extract_ips(F.col(text_col))).withColumn(
        "public_ips", ipf.public_ips(F.col("ips"))
    )


def feed_entries(feed: DataFrame) -> DataFrame:
    """One row per listed address: of doubled ones the most confident, then by category."""
    best = F.max_by(F.struct("category", "confidence"), F.struct("confidence", "category"))
    return feed.groupBy("ip").agg(best.alias("_b")).select("ip", "_b.category", "_b.confidence")


def threat_table(addresses: DataFrame, feed: DataFrame) -> DataFrame:
    """Record key and ``threat`` of the records with a listed address in ``public_ips``.

    The address pairs are narrow and only hits are grouped, so a text full of
    addresses, or an address found everywhere, moves no wide rows. Spark turns
    the join into a broadcast where the feed proves small, and splits an
    address that is found everywhere where it does not.
    """
    # The outer form keeps the optimizer from adding a filter that would
    # evaluate the whole extraction a second time; the join drops the NULLs.
    distinct = F.array_distinct("public_ips")
    pairs = addresses.select(*RECORD, F.posexplode_outer(distinct).alias("pos", "ip"))
    return (
        pairs.join(feed_entries(feed), "ip")
        .groupBy(*RECORD)
        .agg(F.min_by(F.struct("ip", "category", "confidence"), F.struct("pos", "ip")).alias("threat"))
    )


def threat_hits(events: DataFrame, feed: DataFrame) -> DataFrame:
    """Add ``threat``: the feed entry of the first listed public address, NULL when none.

    ``events`` has ``public_ips`` and the record key, whose parts may be NULL.
    A record given more than once gets its hit on every row.
    """
    hosted = with_host(events)
    return join_record(hosted, threat_table(hosted, feed)).select(*events.columns, "threat")


def feed_history(versions: DataFrame) -> DataFrame:
    """Listed addresses with the time in which they were: ``ip, category, confidence, valid_from, valid_to``.

    ``versions`` are whole feeds, cleaned, with the time ``version`` from which
    each one held; it holds until the next one. An entry that stays as it is over
    several versions is one row; ``valid_to`` (excluded) is NULL in the last one.
    """
    times = versions.select("version").distinct()  # one row per change of the feed
    order = Window.orderBy("version")
    steps = times.withColumns({"_n": F.row_number().over(order), "_next": F.lead("version").over(order)})
    entries = versions.dropDuplicates(["version", "ip"]).join(steps, "version")
    own = Window.partitionBy("ip", "category", "confidence").orderBy("_n")
    runs = entries.withColumn("_run", F.col("_n") - F.row_number().over(own))
    return runs.groupBy("ip", "category", "confidence", "_run").agg(
        F.min("version").alias("valid_from"), F.max_by(F.struct("_next"), "_n")["_next"].alias("valid_to")
    ).drop("_run")


def threat_hits_at(events: DataFrame, history: DataFrame, time: str = "event_time") -> DataFrame:
    """``threat_hits`` with the feed as it was at the time of each event, so that a replay gives what the live run gave.

    Events before the first version, or without a time, meet no entry.
    """
    hosted = with_host(events)
    pairs = hosted.select(*RECORD, F.col(time).alias("_at"), F.posexplode_outer(F.array_distinct("public_ips")).alias("pos", "ip"))
    held = (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    met = pairs.join(history, "ip").filter(held)
    hits = met.groupBy(*RECORD).agg(F.min_by(F.struct("ip", "category", "confidence"), F.struct("pos", "ip")).alias("threat"))
    return join_record(hosted, hits).select(*events.columns, "threat")


def with_knowledge(events: DataFrame, knowledge: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Add ``knowledge``: the entry of the event id, NULL when there is none."""
    entry = F.struct("title", "description", "risk_level", "advice", "source")
    dim = broadcast_if_small(
        knowledge.select(F.col("event_id").alias("_kid"), entry.alias("knowledge"))
    )
    return events.join(dim, strip(F.col(event_id)) == F.col("_kid"), "left").drop("_kid")


# Text sections of an analysis.
EXPLAINED = "🆔 Event ID Explained\n"
ANALYSIS = "🕵️‍♂️ Analysis"
RECOMMENDATION = "💡 Recommendation\n"
FALLBACK_ADVICE = "Check the log message manually or contact the system administrator."
FALLBACK_RISK = "Medium"
# Text where there is no usable answer.
FALLBACK_EXPLAINED = ("This Event ID (", ") is an event recorded by the Windows security system.\n\n")
FALLBACK_USER = "\nUser/Entity: Could Not Be Analyzed\nSummary: "
FENCE = "```"

REQUIRED = ("risk_score", "user_entity", "summary", "advice")
OPTIONAL = "event_id_explanation"


def render_answer(explanation: Column, user: Column, summary: Column, risk: Column, advice: Column) -> Column:
    """An answer as text sections; the explanation is left out when empty."""
    first = F.when(explanation != "", F.concat(F.lit(EXPLAINED), explanation, F.lit("\n")))
    return F.concat_ws(
        "\n",
        first,
        F.lit(ANALYSIS),
        F.concat(F.lit("User/Entity: "), user),
        F.concat(F.lit("Summary: "), summary),
        F.concat(F.lit("Risk Level: "), risk, F.lit("\n")),
        F.concat(F.lit(RECOMMENDATION), advice),
    )


def fallback_answer(event_id: Column, reason: Column) -> Column:
    """Text for an answer that cannot be read."""
    return F.concat(
        F.lit(EXPLAINED + FALLBACK_EXPLAINED[0]),
        F.coalesce(event_id, F.lit("Unknown")),
        F.lit(FALLBACK_EXPLAINED[1]),
        F.lit(ANALYSIS + FALLBACK_USER),
        reason,
        F.lit(f"\nRisk Level: {FALLBACK_RISK}\n\n{RECOMMENDATION}{FALLBACK_ADVICE}"),
    )


def _unfenced(raw: Column) -> Column:
    """The JSON of an answer that may sit inside a code fence."""
    tagged = F.split_part(F.split_part(raw, F.lit(FENCE + "json"), F.lit(2)), F.lit(FENCE), F.lit(1))
    bare = F.split_part(raw, F.lit(FENCE), F.lit(2))
    return (
        F.when(raw.contains(FENCE + "json"), strip(tagged))
        .when(raw.contains(FENCE), strip(bare))
        .otherwise(raw)
    )


def parse_answers(answers: DataFrame, event_id: str | None = "event_id") -> DataFrame:
    """Answers as record key, ``analysis, analysis_risk, parsed, reason``, ``answered_at``.

    An answer counts only when it is a JSON object whose four required fields
    are texts; otherwise the fallback text and a medium risk stand in.
    ``reason`` is the unusable answer. Parts of the key that the table lacks are
    NULL.
    """
    for name, kind in (("host", "string"), ("log_source", "string"), ("answered_at", "timestamp")):
        if name not in answers.columns:
            answers = answers.withColumn(name, F.lit(None).cast(kind))
    eid = F.col(event_id) if event_id else F.lit(None).cast("string")
    cleaned = answers.withColumn("_raw", strip(F.coalesce("raw_response", F.lit("")))).withColumn(
        "_json", _unfenced(F.col("_raw"))
    )
    cleaned = cleaned.withColumn(
        "_v", F.when(F.col("_json").rlike(r"(?s)^\{.*\}$"), F.try_parse_json("_json"))
    )

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))

    def value(name: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", "string")

    good = F.col("_v").isNotNull()
    for name in REQUIRED:
        good = good & (kind(name) == "STRING")
    good = good & F.coalesce(kind(OPTIONAL).isin("STRING", "VOID"), F.lit(True))
    parsed = F.coalesce(good, F.lit(False))
    risk = answer_risk(value("risk_score"))
    text = render_answer(value(OPTIONAL), value("user_entity"), value("summary"), risk, value("advice"))
    return cleaned.withColumn("parsed", parsed).select(
        *RECORD,
        F.when(F.col("parsed"), text).otherwise(fallback_answer(eid, F.col("_raw"))).alias("analysis"),
        F.when(F.col("parsed"), risk).otherwise(FALLBACK_RISK).alias("analysis_risk"),
        "parsed",
        F.when(~F.col("parsed"), F.col("_raw")).alias("reason"),
        "answered_at",
    )


def last_answers(parsed: DataFrame) -> DataFrame:
    """Record key and ``answer`` (analysis, analysis_risk, reason): the last one of each record."""
    body = F.struct("analysis", "analysis_risk", "reason")
    return parsed.groupBy(*RECORD).agg(F.max_by(body, F.struct("answered_at", "analysis")).alias("answer"))


INSTRUCTIONS = (
    "You assess Windows security events. Answer with one JSON object and nothing else, with the "
    "fields risk_score (Low, Medium or High), user_entity, summary, advice and, if useful, "
    "event_id_explanation."
)
# Fixed value: how the event is handed over.
REQUEST = "Analyze this Windows security log:\n\n"


def knowledge_note(event_id: Column, knowledge: Column) -> Column:
    """What is known about an event id, as a block of labelled lines."""
    def line(label: str, name: str) -> Column:
        value = knowledge[name]
        return F.when(value != "", F.concat(F.lit(f"\n{label}: "), value))

    return F.concat_ws(
        "",
        F.lit("Known facts about event "),
        event_id,
        line("Title", "title"),
        line("Description", "description"),
        line("Risk", "risk_level"),
        line("Advice", "advice"),
    )


def prompts(events: DataFrame, knowledge: DataFrame, instructions: str = INSTRUCTIONS) -> DataFrame:
    """Prompt rows for an external scorer: record key, ``event_id, system_prompt, user_prompt``.

    The event id is read from the context text. Where it is known, its advice
    and risk are given as binding.
    """
    keyed = with_host(events).withColumn("_eid", event_id_from_text(F.col("context_text")))
    known = with_knowledge(keyed, knowledge, "_eid")
    binding = F.concat(
        F.lit("\n\nA fixed procedure exists for event "),
        F.col("_eid"),
        F.lit('. Use this text unchanged as advice: "'),
        F.coalesce("knowledge.advice", F.lit("")),
        F.lit('" and this value as risk_score: "'),
        F.coalesce("knowledge.risk_level", F.lit("Medium")),
        F.lit('".'),
    )
    return known.select(
        *RECORD,
        F.col("_eid").alias("event_id"),
        F.concat(
            F.lit(instructions), F.when(F.col("knowledge").isNotNull(), binding).otherwise("")
        ).alias("system_prompt"),
        F.concat(F.lit(REQUEST), F.col("context_text")).alias("user_prompt"),
    )
