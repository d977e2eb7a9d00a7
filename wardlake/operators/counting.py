"""Sliding-window threshold counting whose work per task is bounded.

A row fires when at least ``threshold`` candidate rows of its key, itself
included, lie in ``(t - window, t]``; rows of equal time count in sequence
order. Whether that holds needs neither all rows of a key nor all rows of a
time span in one place:

1. Only the first ``threshold`` records of one (key, microsecond) can decide
   anything: if there are more, the later ones always fire. A ranked limit,
   applied before the shuffle as well, keeps just those. A record given more
   than once counts once, and all its rows have the same outcome.
2. They collapse to one point per (key, microsecond). A point adds its rows at
   ``t`` and takes them away at ``t + window``; the running sum of these steps
   is the count inside the window.
3. The running sum is cut into cells of a few seconds. A cell holds at most one
   point per microsecond whatever the data volume, and starts from a carried
   sum that comes from a small table of per-cell totals.
4. The result is a table of firing points, joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Seconds per cell of the running sum.
CELL_SECONDS = 10

#: Spark applies a ranked limit before the shuffle up to this limit only
#: (``spark.sql.optimizer.windowGroupLimitThreshold``).
RANK_LIMIT_PUSHDOWN = 1000
TIE_SALTS = 256

COUNT_COLS = ("_rule", "_key", "_us")


def _first_ties(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` records, in sequence, of every (rule, key, microsecond)."""
    narrow = rows.select(*COUNT_COLS, "_seq", "_window_us", "_threshold")
    if limit > RANK_LIMIT_PUSHDOWN:
        salted = Window.partitionBy(*COUNT_COLS, "_salt").orderBy("_seq")
        narrow = (
            narrow.withColumn("_salt", F.pmod(F.xxhash64("_seq"), F.lit(TIE_SALTS)))
            .withColumn("_rank", F.dense_rank().over(salted))
            .filter(F.col("_rank") <= limit)
            .drop("_salt")
        )
    ties = Window.partitionBy(*COUNT_COLS).orderBy("_seq")
    return narrow.withColumn("_rank", F.dense_rank().over(ties)).filter(F.col("_rank") <= limit)


def firing_points(candidates: DataFrame, max_threshold: int) -> DataFrame:
    """Points ``(_rule, _key, _us, _cut)`` at which rows fire.

    ``candidates`` has ``_rule, _key, _us, _seq, _window_us, _threshold``.
    ``_cut`` is NULL when all rows of the point fire, else only rows with
    ``_seq`` after it do.
    """
    points = (
        _first_ties(candidates, max_threshold)
        .groupBy(*COUNT_COLS)
        .agg(
            F.size(F.collect_set("_seq")).alias("_rows"),
            F.first("_window_us").alias("_window_us"),
            F.first("_threshold").alias("_threshold"),
            F.sort_array(F.collect_set("_seq")).alias("_seqs"),
        )
    )
    steps = points.select(
        "_rule",
        "_key",
        F.explode(
            F.array(
                F.struct(
                    F.col("_us").alias("_at"),
                    F.lit(1).alias("_kind"),
                    F.col("_rows").alias("_step"),
                    F.col("_threshold"),
                    F.col("_seqs"),
                ),
                F.struct(
                    (F.col("_us") + F.col("_window_us")).alias("_at"),
                    F.lit(0).alias("_kind"),
                    (-F.col("_rows")).alias("_step"),
                    F.lit(None).cast("int").alias("_threshold"),
                    F.lit(None).cast(points.schema["_seqs"].dataType).alias("_seqs"),
                ),
            )
        ).alias("_s"),
    ).select("_rule", "_key", "_s.*")
    cell_us = F.lit(CELL_SECONDS * 1_000_000)
    steps = steps.withColumn("_cell", F.col("_at") - F.pmod(F.col("_at"), cell_us))
    carried = _carried(steps.groupBy("_rule", "_key", "_cell").agg(F.sum("_step").alias("_total")))
    inside = (
        Window.partitionBy("_rule", "_key", "_cell")
        .orderBy("_at", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = F.col("_count") - F.col("_step")
    quiet = F.greatest(F.lit(0), F.col("_threshold") - 1 - before).cast("int")
    return (
        steps.join(carried, ["_rule", "_key", "_cell"])
        .withColumn("_count", F.col("_carried") + F.sum("_step").over(inside))
        .filter((F.col("_kind") == 1) & (F.col("_count") >= F.col("_threshold")))
        .withColumn("_quiet", quiet)
        .select(
            "_rule",
            "_key",
            F.col("_at").alias("_us"),
            F.when(F.col("_quiet") > 0, F.try_element_at("_seqs", F.col("_quiet"))).alias("_cut"),
            F.lit(True).alias("_hit"),
        )
    )


def _carried(cells: DataFrame) -> DataFrame:
    """Sum of all cells before each one, in two levels: days, and cells of a day."""
    day_us = F.lit(86_400_000_000)
    cells = cells.withColumn("_day", F.col("_cell") - F.pmod(F.col("_cell"), day_us))
    before = lambda *keys: Window.partitionBy("_rule", "_key", *keys).rowsBetween(Window.unboundedPreceding, -1)
    days = cells.groupBy("_rule", "_key", "_day").agg(F.sum("_total").alias("_sum"))
    days = days.withColumn("_base", F.coalesce(F.sum("_sum").over(before().orderBy("_day")), F.lit(0)))
    inner = F.coalesce(F.sum("_total").over(before("_day").orderBy("_cell")), F.lit(0))
    joined = cells.withColumn("_inner", inner).join(days.drop("_sum"), ["_rule", "_key", "_day"])
    return joined.select("_rule", "_key", "_cell", (F.col("_base") + F.col("_inner")).alias("_carried"))


def mark_fired(rows: DataFrame, max_threshold: int) -> DataFrame:
    """Add ``_fired``: True where the row's rule fires, False elsewhere.

    Rows without a candidate rule have ``_rule`` NULL. They must survive the
    join, so they get a rule number that never fires, and spread by time.
    """
    points = firing_points(rows.filter(F.col("_rule").isNotNull()), max_threshold)
    keyed = rows.withColumn("_rule", F.coalesce("_rule", F.lit(-1))).withColumn(
        "_key", F.coalesce("_key", F.lit(""))
    )
    fired = F.col("_hit").isNotNull() & (F.col("_cut").isNull() | (F.col("_seq") > F.col("_cut")))
    return (
        keyed.join(points, list(COUNT_COLS), "left")
        .withColumn("_fired", F.coalesce(fired, F.lit(False)))
        .drop("_cut", "_hit")
    )


def fired_rows(rows: DataFrame, max_threshold: int) -> DataFrame:
    """Only the rows whose rule fires."""
    points = firing_points(rows, max_threshold)
    return (
        rows.join(points, list(COUNT_COLS))
        .filter(F.col("_cut").isNull() | (F.col("_seq") > F.col("_cut")))
        .drop("_cut", "_hit")
    )


def micros(event_time: Column) -> Column:
    return F.unix_micros(event_time.cast("timestamp"))
