"""What a stream of events must remember between micro-batches, as tables.

All state is files in a shared folder: nothing is held in one task, and a repeated
micro-batch reads and writes the same folders again.

* ``seen``: record keys, so that a record read twice counts once;
* ``tail``: events a threshold rule may still count;
* ``newest``: the newest time of every host and channel, no later than the clock
  of the machine allows, so one wrong clock cannot empty the others' history, and
  when the channel last delivered rows;
* ``rules``: the threshold rules the tail was kept for.

The first two grow with the events, so each micro-batch adds a part of its own
rows only (see ``parts``); the other two have a row per channel and per rule.
Whether a record is known is told by the zones and filters of the parts, and the
keys themselves are read only where those say so. Of the tail a micro-batch reads
what lies within the reach of the rules before its first event.

An event is late only against its own channel. Record keys are kept as long as
their own channel may deliver them again, and history goes back as far as the
slowest channel that is still alive needs it. A channel is alive by what arrives,
not by the times of its events: one that is read a year behind holds its history.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wardlake.operators.detect import Plan, event_facts, with_host
from wardlake.operators.rules import Rule, check_patterns, predicate
from wardlake.schemas import PROCESS_DETAILS, RAW_EVENT, RECORD
from wardlake.session import delete
from wardlake.streaming.parts import PartTable, without_keys

CARRIED = (*RECORD, "event_id", "event_time", "message", "details")
#: How far an event may lie ahead of this machine's clock and still move the limits.
SKEW = timedelta(minutes=1)
#: A channel that has delivered nothing for so long, by this machine's clock, holds nothing back.
IDLE = timedelta(days=1)
SEEN = "host string, log_source string, record_id long, event_time timestamp"
TAIL = T.StructType([*(f for f in RAW_EVENT.fields if f.name in CARRIED), T.StructField("details", PROCESS_DETAILS)])
RULES_KEPT = "rule string, bound timestamp"
#: Files of the table of channels.
NEWEST_FILES = 4
#: Parts that nothing asks for are looked for every so many micro-batches.
DROP_EVERY = 4
NEWEST = "host string, log_source string, newest timestamp, arrived timestamp"


def horizon(rules: list[Rule]) -> timedelta:
    """How far back the outcome of a rule can reach.

    A chained rule looks back one window and, through the rule before it,
    another one; the sum of all windows covers any chain.
    """
    return timedelta(seconds=sum(r.time_window for r in rules if r.enabled and r.counted))


def _counted(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.enabled and r.counted]


class EventState:
    """State of one job before and after one micro-batch."""

    def __init__(self, spark: SparkSession, path: str, batch_id: int, rules: list[Rule], watermark: timedelta, idle: timedelta | None = IDLE):
        """``idle`` None: every channel holds its history for ever."""
        self.spark, self.path, self.batch_id = spark, path, batch_id
        self.rules = check_patterns(spark, rules)
        self.seen = PartTable(spark, f"{path}/seen", SEEN, RECORD, "event_time")
        self.tail = PartTable(spark, f"{path}/tail", TAIL, time="event_time")
        #: One row per threshold rule, and one with the time up to which no event counts any more.
        self._rules_before = self._read("rules", RULES_KEPT).collect()
        #: A batch without threshold rules keeps what the rules before it need.
        self.kept_for = _counted(self.rules) or self._last_rules()
        self.idle = idle
        #: Channels of the rows given to ``admit``, those that are late or known already too.
        self.delivered: DataFrame | None = None
        self.keep = max(watermark, horizon(self.kept_for))

    def _read(self, name: str, schema) -> DataFrame:
        """A table of the micro-batch before; only the first one has none, anything else missing is an error."""
        if self.batch_id == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={self.batch_id - 1}")

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={self.batch_id}")

    def _last_rules(self) -> list[Rule]:
        lists = ("mitre", "tags", "exclude_users", "include_users")
        given = [json.loads(r["rule"]) for r in self._rules_before if r["rule"] is not None]
        return [Rule(**{k: tuple(v) if k in lists else frozenset(v) if k == "broken" else v for k, v in d.items()}) for d in given]

    def _limits(self, newest: DataFrame) -> DataFrame:
        """``_limit``: the time up to which an event of a channel is late."""
        return newest.select("host", "log_source", (F.col("newest") - F.make_interval(secs=F.lit(self.keep.total_seconds()))).alias("_limit"))

    def _with_limit(self, rows: DataFrame, limits: DataFrame) -> DataFrame:
        same = rows["host"].eqNullSafe(limits["host"]) & rows["log_source"].eqNullSafe(limits["log_source"])
        return rows.join(limits, same, "left").select(rows["*"], "_limit")

    def admit(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(events not seen before, events too late to tell); both once per record."""
        once = with_host(batch).dropDuplicates(list(RECORD))
        self.delivered = once.select("host", "log_source").distinct()
        marked = self._with_limit(once, self._limits(self._read("newest", NEWEST)))
        late = _late("event_time")
        fresh = marked.filter(~late).drop("_limit")
        return without_keys(fresh, self.seen.lookup(fresh, self.batch_id), RECORD), marked.filter(late).drop("_limit")

    def advance(self, fresh: DataFrame, prepared: DataFrame) -> None:
        """Write the state after this micro-batch and delete what the one before the last left."""
        clock = datetime.now(timezone.utc)
        before = self._read("newest", NEWEST).withColumn("arrived", F.coalesce("arrived", F.lit(clock)))
        seen_now = fresh.groupBy("host", "log_source").agg(F.max(F.least("event_time", F.lit(clock + SKEW))).alias("newest"))
        if self.delivered is not None:
            seen_now = seen_now.unionByName(self.delivered, allowMissingColumns=True)
        newest = before.unionByName(seen_now.withColumn("arrived", F.lit(clock)))
        newest = newest.groupBy("host", "log_source").agg(F.max("newest").alias("newest"), F.max("arrived").alias("arrived"))
        self._write(newest.coalesce(NEWEST_FILES), "newest")
        newest = self.spark.read.schema(newest.schema).parquet(f"{self.path}/newest/batch={self.batch_id}")
        limits = self._limits(newest)
        # what ``admit`` would still take, rows without a time included
        asked_for = lambda rows, oldest: self._with_limit(rows, limits).filter(~_late("event_time")).drop("_limit")
        self.seen.add(fresh.select(*RECORD, "event_time"), self.batch_id, asked_for)
        may_count = F.lit(False)
        for rule in self.kept_for:
            may_count = may_count | predicate(rule)
        bound = self._bound(newest, clock)
        alive = lambda rows: rows if bound is None else rows.filter(F.col("event_time") > F.lit(bound))
        self.tail.add(alive(prepared.select(*CARRIED).filter(may_count)), self.batch_id, lambda rows, oldest: alive(rows))
        bound_before = next((r["bound"] for r in self._rules_before if r["rule"] is None), None)
        if self.batch_id % DROP_EVERY == DROP_EVERY - 1:
            self._drop_seen(self._limits(before))
            if bound_before is not None:
                self.tail.drop(self.tail.past(bound_before, self.batch_id))
        described = [json.dumps({k: sorted(v) if isinstance(v, frozenset) else v for k, v in asdict(r).items()}) for r in self.kept_for]
        rows = [(None, bound), *((d, None) for d in described)]
        self._write(self.spark.createDataFrame(rows, RULES_KEPT).coalesce(1), "rules")
        for name in ("newest", "rules"):
            delete(self.spark, f"{self.path}/{name}/batch={self.batch_id - 2}")

    def _bound(self, newest: DataFrame, clock: datetime) -> datetime | None:
        """The time up to which no event counts any more; None where that is not known."""
        living = newest if self.idle is None else newest.filter(F.col("arrived") >= F.lit(clock - self.idle))
        slowest = living.agg(F.min("newest")).first()[0]
        return None if slowest is None else slowest - self.keep

    def _drop_seen(self, limits: DataFrame) -> None:
        """Delete parts all of whose keys were late before this micro-batch, so it has not asked for them."""
        zones = self._with_limit(self.seen.zones(self.batch_id), limits)
        open_ = F.col("_timeless") | ~_late("_newest")
        dead = zones.groupBy("_part").agg(F.bool_or(open_).alias("_open")).filter(~F.col("_open"))
        self.seen.drop([r["_part"] for r in dead.collect()])  # a few parts

    def facts(self, prepared: DataFrame, plan: Plan, strict_fields: bool = False) -> DataFrame:
        """Facts of the new events, ``public_ips`` included, and of the events remembered that they may count."""
        ips = F.col("public_ips") if "public_ips" in prepared.columns else F.array().cast("array<string>")
        new = event_facts(prepared, plan, strict_fields, public_ips=ips)
        first = prepared.agg(F.min("event_time")).first()[0] if plan.counted else None
        if first is None:
            return new
        old = self.tail.read(self.batch_id).filter(F.col("event_time") > F.lit(first - horizon(self.rules)))
        return new.unionByName(event_facts(old, plan, strict_fields, public_ips=F.array().cast("array<string>")))


def _late(time: str) -> Column:
    return F.coalesce(F.col(time) <= F.col("_limit"), F.lit(False))
