"""Streaming jobs: events to stored rows and blocks, late answers, running counters, timeline."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from wardlake.operators.detect import Plan, join_record, rule_numbers, with_host
from wardlake.operators.enrich import threat_hits, with_ips, with_knowledge
from wardlake.operators.reports import TIMELINE_STEP, risk_distribution, technique_counts, timeline
from wardlake.operators.respond import block_candidates, manual_blocks, new_blocks
from wardlake.operators.rules import Rule
from wardlake.operators.traffic import traffic_counts
from wardlake.plans.process import prompt_rows, rescored, scored_from, stored_rows
from wardlake.schemas import RAW_EVENT, RECORD, RESULT, THREAT
from wardlake.session import cut_lineage, cutting, delete, folders, make_folder
from wardlake.sources import logs
from wardlake.sources.events import POLL_SECONDS, prepare
from wardlake.streaming.parts import FAN, PartTable, newest, with_keys, without_keys
from wardlake.streaming.state import IDLE, EventState

#: How long a re-read record is recognised at least, and how late an event may
#: come after others of its channel; never under the longest reach of a rule.
WATERMARK = "10 minutes"
KEPT = timedelta(minutes=10)
#: Parts of a keyed table are merged every so many micro-batches.
MERGE_EVERY = 20

Rules = list[Rule] | Callable[[], list[Rule]]
Table = DataFrame | Callable[[], DataFrame] | None


def _now(value):
    """A value given directly, or made anew for each micro-batch."""
    return value() if callable(value) else value


def _trigger(writer, available_now: bool):
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{POLL_SECONDS} seconds")


def _start(source: DataFrame, handle: Callable[[DataFrame, int], None], base_dir: str, name: str, available_now: bool) -> StreamingQuery:
    """``handle`` for every micro-batch, whose rows are kept while it runs."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            with cutting(batch.sparkSession):
                handle(batch, batch_id)
        finally:
            batch.unpersist()

    writer = source.writeStream.queryName(name).option("checkpointLocation", f"{base_dir}/checkpoints/{name}").foreachBatch(run)
    return _trigger(writer, available_now).start()


def _replace(df: DataFrame, path: str, tag: str) -> None:
    """Write the rows of one micro-batch so that a repeated attempt replaces its own."""
    df.withColumn("batch", F.lit(tag)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def distinct_stream(
    events: DataFrame, base_dir: str, name: str = "distinct", available_now: bool = False, kept: timedelta = KEPT, idle: timedelta | None = IDLE
) -> StreamingQuery:
    """Each record once, although reads overlap: new events to ``base_dir/events``, those too late to tell to ``base_dir/late``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        state = EventState(batch.sparkSession, f"{base_dir}/state/{name}", batch_id, [], kept, idle)
        fresh, late = state.admit(batch)
        fresh = fresh.persist()
        try:
            _replace(late, f"{base_dir}/late", f"{name}-{batch_id}")
            fresh.write.mode("overwrite").parquet(f"{base_dir}/events/batch={batch_id}")
            state.advance(fresh, prepare(fresh))
        finally:
            fresh.unpersist()

    return _start(events, handle, base_dir, name, available_now)


def process_stream(
    events: DataFrame,
    rules: Rules,
    feed: Table,
    base_dir: str,
    answers: Table = None,
    name: str = "events",
    available_now: bool = False,
    kept: timedelta = KEPT,
    knowledge: Table = None,
    wait: bool = False,
    strict_fields: bool = False,
    idle: timedelta | None = IDLE,
    positional_strict: bool = False,
    rollups: bool = False,
) -> StreamingQuery:
    """Run the event job on a stream of raw events.

    ``rules``, ``feed``, ``answers`` and ``knowledge`` may be functions; they are
    then called for every micro-batch, which picks up changed files while
    running. Stored rows go to ``base_dir/logs``, additions to the block list to
    ``base_dir/blocks``, events that come later than ``kept`` after the newest of
    their channel to ``base_dir/late``. A channel that has delivered nothing for
    ``idle`` no longer holds history for its threshold rules (None: all do). With
    ``wait``, scored events go to ``base_dir/arrived`` for ``answer_stream``, and
    are stored when their answer is there. With ``knowledge``, prompts for an
    external scorer go to ``base_dir/prompts``, after that. With ``rollups``, the
    counts of the reports are kept beside the stored rows (``read_rollups``).
    Everything a micro-batch writes is keyed by its number, so a repeated
    micro-batch replaces its own output.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, tag = batch.sparkSession, f"{name}-{batch_id}"
        state = EventState(spark, f"{base_dir}/state/{name}", batch_id, _now(rules), kept, idle)
        fresh, late = state.admit(batch)
        fresh = fresh.persist()
        try:
            _replace(late, f"{base_dir}/late", tag)
            prepared = with_ips(prepare(fresh, positional_strict))
            plan = Plan.of(spark, state.rules)
            facts = cut_lineage(state.facts(prepared, plan, strict_fields))
            state.advance(fresh, prepared)
            scored = scored_from(fresh, plan, rule_numbers(facts, plan), facts, _now(feed), _now(answers))
            if wait:
                _replace(scored.select(*PENDING.fieldNames()), f"{base_dir}/arrived", tag)
            else:
                _finish(scored, base_dir, name, batch_id, rollups=rollups)
            if knowledge is not None:
                _replace(prompt_rows(fresh, _now(knowledge)), f"{base_dir}/prompts", tag)
        finally:
            fresh.unpersist()

    return _start(events, handle, base_dir, name, available_now)


# --- block list ----------------------------------------------------------------

BLOCKS = "ip string, rule_name string, first_seen timestamp, events long, state string, added_at timestamp"
#: The writer of what is blocked and released by hand.
BY_HAND = "by_hand"


def _blocks_of(spark: SparkSession, base_dir: str, writer: str) -> PartTable:
    return PartTable(spark, f"{base_dir}/blocks/{writer}", BLOCKS, ("ip",))


def _latest_blocks(spark: SparkSession, base_dir: str, own: tuple[str, int] | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """The last word of all writers on each address; of ``own`` (writer, micro-batch) only what is older."""
    found = spark.createDataFrame([], BLOCKS)
    for writer in folders(spark, f"{base_dir}/blocks"):
        table, before = _blocks_of(spark, base_dir, writer), own[1] if own and own[0] == writer else None
        rows = table.read(before) if wanted is None else table.lookup(wanted, before)
        found = found.unionByName(rows.drop("changed"))
    return newest(found, ("ip",), "added_at")


def read_blocks(spark: SparkSession, base_dir: str) -> DataFrame:
    """Addresses blocked now: added, and not released since."""
    return _latest_blocks(spark, base_dir).filter("state = 'blocked'").drop("state")


def release(ips: DataFrame, base_dir: str) -> None:
    """Take addresses off the block list; a later event may block them again."""
    rows = ips.select("ip").distinct().withColumn("state", F.lit("released"))
    _by_hand(rows.unionByName(ips.sparkSession.createDataFrame([], BLOCKS).drop("added_at"), allowMissingColumns=True), base_dir)


def block(requests: DataFrame, base_dir: str) -> None:
    """Block requested addresses (``ip``, ``event_time``) that are valid, public and not blocked yet."""
    blocked = read_blocks(requests.sparkSession, base_dir)
    _by_hand(manual_blocks(requests, blocked).withColumn("state", F.lit("blocked")), base_dir)


def _by_hand(rows: DataFrame, base_dir: str) -> None:
    table = _blocks_of(rows.sparkSession, base_dir, BY_HAND)
    table.add(rows.withColumn("added_at", F.current_timestamp()), table.next_batch())


# --- roll-ups --------------------------------------------------------------------

ROLLUP = "report string, value string, log_count long"


def rollup(stored: DataFrame) -> DataFrame:
    """Counts of the reports on stored rows: per time step, risk and technique."""
    steps = timeline(stored).withColumn("value", F.date_format("time_interval", "yyyy-MM-dd HH:mm:ss"))
    labelled = stored.withColumn("risk_score_raw", F.coalesce("risk_score_raw", "risk_score"))  # as the table is read
    risks = risk_distribution(labelled, "risk_score_raw").withColumn("value", F.col("risk_level"))
    found = technique_counts(stored).withColumn("value", F.col("technique"))
    parts = [df.select(F.lit(name).alias("report"), "value", "log_count") for name, df in (("timeline", steps), ("risk", risks), ("technique", found))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("report", "value").agg(F.sum("log_count").alias("log_count"))


def _rollup_of(spark: SparkSession, base_dir: str, writer: str) -> PartTable:
    return PartTable(spark, f"{base_dir}/rollups/{writer}", ROLLUP)


def read_rollups(spark: SparkSession, base_dir: str) -> DataFrame:
    """``report, value, log_count`` of all rows stored by jobs with ``rollups``; no stored row is read."""
    rows = spark.createDataFrame([], ROLLUP)
    for writer in folders(spark, f"{base_dir}/rollups"):
        rows = rows.unionByName(_rollup_of(spark, base_dir, writer).read())
    return _summed(rows)


def _finish(scored: DataFrame, base_dir: str, name: str, batch_id: int, tag: str | None = None, rollups: bool = False) -> None:
    """Stored rows and block-list additions of scored events, and their counts with ``rollups``."""
    spark, scored = scored.sparkSession, scored.persist()
    try:
        logs.append_batch(stored_rows(scored), f"{base_dir}/logs", tag or f"{name}-{batch_id}")
        if rollups:
            counts = rollup(stored_rows(scored))
            _rollup_of(spark, base_dir, name).add(counts, batch_id, lambda rows, oldest: _summed(rows))
        wanted = block_candidates(scored)
        before = _latest_blocks(spark, base_dir, (name, batch_id), wanted).filter("state = 'blocked'")
        added = new_blocks(scored, before).withColumns({"state": F.lit("blocked"), "added_at": F.current_timestamp()})
        _blocks_of(spark, base_dir, name).add(added, batch_id)
    finally:
        scored.unpersist()


# --- events that wait for an answer ------------------------------------------------

#: What is kept of an event until its answer comes.
_FOUND = [T.StructField(n, t) for n, t in (("detection", RESULT), ("threat", THREAT), ("public_ips", T.ArrayType(T.StringType())))]
PENDING = T.StructType([*(f for f in RAW_EVENT.fields if f.name in (*RECORD, "event_id", "event_time", "message")), *_FOUND])
_KEY = [f for f in RAW_EVENT.fields if f.name in RECORD]
_ANSWER = T.StructType([T.StructField(c, T.StringType()) for c in ("analysis", "analysis_risk", "reason")])
_SIDE = [T.StructField("state", T.StringType()), T.StructField("at", T.TimestampType())]
WAITING = T.StructType([*PENDING.fields, *_SIDE])
EARLY = T.StructType([*_KEY, T.StructField("answer", _ANSWER), T.StructField("answered_at", T.TimestampType()), *_SIDE])
DONE = T.StructType([*_KEY, *_SIDE])
#: How long an answer waits for its event, and how long it is remembered that an event is finished.
ANSWERS_KEPT = timedelta(days=1)


class _Waiting:
    """Both sides of the wait, as tables of newest rows: open, then done."""

    def __init__(self, spark: SparkSession, base_dir: str, name: str):
        at = f"{base_dir}/state/{name}"
        self.events = PartTable(spark, f"{at}/waiting", WAITING, RECORD, "event_time")
        self.answers = PartTable(spark, f"{at}/early", EARLY, RECORD, "at")
        self.expired = PartTable(spark, f"{at}/expired", DONE, RECORD, "at")

    def unfinished(self, events: DataFrame) -> DataFrame:
        return without_keys(events, self.expired.lookup(events), RECORD)


def _marked(rows: DataFrame, state: str, at: datetime) -> DataFrame:
    return rows.withColumns({"state": F.lit(state), "at": F.lit(at)})


def _done(rows: DataFrame, like: T.StructType, at: datetime) -> DataFrame:
    """Keys of finished rows, in the form of a table that holds more of open ones."""
    empty = rows.sparkSession.createDataFrame([], like)
    return empty.unionByName(_marked(rows.select(*RECORD), "done", at), allowMissingColumns=True)


def answer_stream(
    answers: DataFrame,
    base_dir: str,
    name: str = "answers",
    available_now: bool = False,
    answers_kept: timedelta = ANSWERS_KEPT,
    timeout: timedelta | None = None,
    rollups: bool = False,
) -> StreamingQuery:
    """Finish events and their (parsed) answers as both have come: fusion, stored row, block list.

    Whichever side comes first waits for the other: events of ``process_stream``
    (with ``wait``) until an answer comes, until they are older than ``timeout`` by
    this machine's clock, which is looked at every ``FAN`` micro-batches, or until
    ``expire_pending``; answers for ``answers_kept``. An event takes the last answer
    there is when both meet; answers to a finished event change nothing.
    """
    spark = answers.sparkSession
    make_folder(spark, f"{base_dir}/arrived")
    source = spark.readStream.schema(PENDING).option("cleanSource", "delete").option("recursiveFileLookup", "true")
    arrived = source.parquet(f"{base_dir}/arrived").select(F.struct(*PENDING.fieldNames()).alias("event"))
    given = answers.select(F.struct(*[F.col(c) for c in answers.columns]).alias("answer"))
    both = arrived.unionByName(given, allowMissingColumns=True)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, held, now = batch.sparkSession, _Waiting(batch.sparkSession, base_dir, name), datetime.now(timezone.utc)
        events = batch.filter("event IS NOT NULL").select("event.*").dropDuplicates(list(RECORD))
        new = _last(batch.filter("answer IS NOT NULL").select("answer.*"))
        # what is known of these records, the finished ones too
        known = cut_lineage(held.events.lookup(events.select(*RECORD).union(new.select(*RECORD)), batch_id))
        fresh = without_keys(events, known, RECORD)
        open_ = held.unfinished(known.filter("state = 'open'").select(*PENDING.fieldNames()).unionByName(fresh))
        early = held.answers.lookup(fresh, batch_id).filter((F.col("state") == "open") & (F.col("at") > F.lit(now - answers_kept)))
        found = newest(new.unionByName(early.select(*new.columns)), RECORD, "answered_at")
        scored = rescored(open_, found.select(*RECORD, "answer"), answered_only=True, last=True)
        if timeout is not None and batch_id % FAN == FAN - 1:
            overdue = held.unfinished(held.events.read(batch_id).filter(F.col("state") == "open").select(*PENDING.fieldNames()).unionByName(fresh))
            overdue = without_keys(overdue.filter(F.col("event_time") < F.lit(now - timeout)), found, RECORD)
            scored = scored.unionByName(rescored(overdue, None))
        scored = cut_lineage(scored)
        _finish(scored, base_dir, name, batch_id, rollups=rollups)
        recent = F.col("at") > F.lit(now - ANSWERS_KEPT)
        waiting = _marked(without_keys(fresh, scored, RECORD), "open", now).unionByName(_done(scored, WAITING, now))
        held.events.add(waiting, batch_id, lambda rows, oldest: rows.filter((F.col("state") == "open") | recent) if oldest else rows)
        # answers to finished events go, the others wait
        gone = known.filter("state = 'done'").select(*RECORD).union(scored.select(*RECORD))
        rest = _marked(without_keys(new, gone, RECORD), "open", now).unionByName(_done(with_keys(early, scored, RECORD), EARLY, now))
        held.answers.add(rest, batch_id, lambda rows, oldest: rows.filter((F.col("at") > F.lit(now - answers_kept)) & (F.lit(not oldest) | (F.col("state") == "open"))))

    return _start(both, handle, base_dir, name, available_now)


def _last(parsed: DataFrame) -> DataFrame:
    """Record key, ``answer``, ``answered_at``: the last answer of each record."""
    body = F.struct("analysis", "analysis_risk", "reason").cast(_ANSWER)
    return parsed.groupBy(*RECORD).agg(
        F.max_by(body, F.struct("answered_at", "analysis")).alias("answer"), F.max("answered_at").alias("answered_at")
    )


def read_pending(spark: SparkSession, base_dir: str, name: str = "answers") -> DataFrame:
    """Events that wait for an answer, those that the answer job has not read yet too."""
    held, columns = _Waiting(spark, base_dir, name), PENDING.fieldNames()
    known = held.events.read()
    arrived = spark.createDataFrame([], PENDING)
    if folders(spark, f"{base_dir}/arrived"):
        arrived = spark.read.schema(PENDING).option("recursiveFileLookup", "true").parquet(f"{base_dir}/arrived")
    open_ = known.filter("state = 'open'").select(*columns).unionByName(without_keys(arrived, known, RECORD))
    return without_keys(open_, held.expired.read(), RECORD)


def expire_pending(spark: SparkSession, base_dir: str, tag: str, before=None, name: str = "answers", rollups: bool = False) -> None:
    """Finish events that wait since before a time (all without one) with the text for a missing answer.

    For when the answer job does not run; it has ``timeout`` for itself.
    """
    held = _Waiting(spark, base_dir, name)
    with cutting(spark):
        waiting = read_pending(spark, base_dir, name)
        if before is not None:
            waiting = waiting.filter(F.col("event_time") < F.lit(before))
        scored = cut_lineage(rescored(waiting, None))
        batch_id = held.expired.next_batch()
        _finish(scored, base_dir, f"{name}-expired", batch_id, tag, rollups)
        now = datetime.now(timezone.utc)
        recent = F.col("at") > F.lit(now - ANSWERS_KEPT)
        held.expired.add(_done(scored, DONE, now), batch_id, lambda rows, oldest: rows if not oldest else rows.filter(recent))


def detect_stream(
    events: DataFrame,
    rules: Rules,
    base_dir: str,
    name: str = "detect",
    available_now: bool = False,
    kept: timedelta = KEPT,
    strict_fields: bool = False,
    idle: timedelta | None = IDLE,
    positional_strict: bool = False,
) -> StreamingQuery:
    """Only the detection: every event with its first matching rule, to ``base_dir/detections``; ``kept`` and ``idle`` as for ``process_stream``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = EventState(spark, f"{base_dir}/state/{name}", batch_id, _now(rules), kept, idle)
        fresh, late = state.admit(batch)
        fresh = fresh.persist()
        try:
            _replace(late, f"{base_dir}/late", f"{name}-{batch_id}")
            prepared = prepare(fresh, positional_strict)
            plan = Plan.of(spark, state.rules)
            facts = cut_lineage(state.facts(prepared, plan, strict_fields))
            state.advance(fresh, prepared)
            matched = plan.reported(join_record(fresh, rule_numbers(facts, plan)))
            matched.select(*RECORD, "event_id", "event_time", "detection").write.mode("overwrite").parquet(
                f"{base_dir}/detections/batch={batch_id}"
            )
        finally:
            fresh.unpersist()

    return _start(events, handle, base_dir, name, available_now)


def enrich_stream(
    events: DataFrame, feed: Table, knowledge: Table, base_dir: str, name: str = "enrich", available_now: bool = False
) -> StreamingQuery:
    """Parsing, addresses, feed hit and event knowledge of a stream, to ``base_dir/enriched``.

    One row per event, by the functions of the batch job: ``threat`` is the entry
    of the first listed address in the text, ``knowledge`` that of the event id.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rich = with_knowledge(threat_hits(with_ips(prepare(with_host(batch))), _now(feed)), _now(knowledge))
        rich.write.mode("overwrite").parquet(f"{base_dir}/enriched/batch={batch_id}")

    return _start(events, handle, base_dir, name, available_now)


def running_counts(packets: DataFrame) -> DataFrame:
    """Cumulative packet counters as a streaming table, for update-mode queries."""
    return traffic_counts(packets)


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("dimension", "value").agg(F.sum("packets").alias("packets"), F.min("first_seen").alias("first_seen"))


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(f.split("=")[1]) for f in folders(spark, path) if f.startswith("batch="))


def count_stream(
    packets: DataFrame, base_dir: str, name: str = "traffic", available_now: bool = False, merge_every: int = MERGE_EVERY
) -> StreamingQuery:
    """Packet counters: a part per micro-batch, merged by key every ``merge_every`` of them.

    ``read_counters`` adds the last total and the few parts after it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        traffic_counts(batch).write.mode("overwrite").parquet(f"{base_dir}/counts/batch={batch_id}")
        if batch_id % merge_every != merge_every - 1:
            return
        total = _counters(spark, base_dir, batch_id)
        total.write.mode("overwrite").parquet(f"{base_dir}/totals/batch={batch_id}")
        # what the total before this one covers is asked for by no one, and not by a repeated attempt
        done = [b for b in _batches(spark, f"{base_dir}/totals") if b < batch_id]
        for b in _batches(spark, f"{base_dir}/counts"):
            if done and b <= done[-1]:
                delete(spark, f"{base_dir}/counts/batch={b}")
        for b in done[:-1]:
            delete(spark, f"{base_dir}/totals/batch={b}")

    return _start(packets, handle, base_dir, name, available_now)


def _counters(spark: SparkSession, base_dir: str, before: int | None = None) -> DataFrame:
    totals = [b for b in _batches(spark, f"{base_dir}/totals") if before is None or b < before]
    paths = [f"{base_dir}/counts/batch={b}" for b in _batches(spark, f"{base_dir}/counts") if not totals or b > totals[-1]]
    if totals:
        paths.append(f"{base_dir}/totals/batch={totals[-1]}")
    return _added(spark.read.parquet(*paths))


def read_counters(spark: SparkSession, base_dir: str) -> DataFrame:
    """Counters since the start, in the form ``top_talkers`` takes."""
    return _counters(spark, base_dir)


def timeline_stream(logs_stream: DataFrame, step: str = TIMELINE_STEP, watermark: str = WATERMARK) -> DataFrame:
    """Rows per tumbling time step; a step is final once the watermark has passed it."""
    return (
        logs_stream.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", step).alias("_w"))
        .agg(F.count(F.lit(1)).alias("log_count"))
        .select(F.col("_w.start").alias("time_interval"), "log_count")
    )
