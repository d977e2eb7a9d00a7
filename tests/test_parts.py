"""Tables of parts: newest rows, merges, lookups that open only what they must, repeated attempts."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from replay import START
from wardlake.session import cut_lineage, cutting, shared_dir
from wardlake.streaming import parts
from wardlake.streaming.parts import PartTable, newest, with_keys, without_keys

SCHEMA = "host string, source string, number long, value string, at timestamp"
KEYS = ("host", "source", "number")


@pytest.fixture(autouse=True)
def every_part_has_an_index(monkeypatch):
    monkeypatch.setattr(parts, "INDEX_ROWS", 1)


def table(spark, path, fan=3):
    return PartTable(spark, str(path), SCHEMA, KEYS, "at", fan)


def frame(spark, rows):
    return spark.createDataFrame([(h, s, n, v, START + dt.timedelta(seconds=t)) for h, s, n, v, t in rows], SCHEMA).repartition(2)


def plain(df):
    return sorted((tuple(r) for r in df.select(*KEYS, "value").collect()), key=str)


def some_rows(rng, k):
    keys = {(rng.choice((None, "h")), rng.choice(("a", None)), rng.choice((None, rng.randrange(10 * k, 10 * k + 30)))) for _ in range(8)}
    return [(*key, f"{k}-{i}", k) for i, key in enumerate(sorted(keys, key=str))]


@pytest.mark.parametrize("least", [1, 12])
def test_newest_rows_over_merges(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(parts, "INDEX_ROWS", least)
    rng, want, held = random.Random(4), {}, table(spark, tmp_path)
    for k in range(10):
        rows = some_rows(rng, k)
        asked = frame(spark, [*rows, ("no", "a", 1, "", 0)])
        found = held.lookup(asked, k)
        assert plain(found) == sorted(((*key, want[key]) for key in {r[:3] for r in rows} if key in want), key=str)
        for _ in range(1 + (k % 4 == 1)):  # a repeated attempt changes nothing
            held.add(frame(spark, rows), k)
        want |= {r[:3]: r[3] for r in rows}
        assert plain(held.read()) == sorted(((*key, v) for key, v in want.items()), key=str)
    # 0-8 is one part, and 9
    assert held.parts() == [(0, 8), (9, 9)]
    assert len(held.parts(8)) == 0 and held.parts(9) == [(0, 8)]
    assert held.next_batch() == 10


def test_what_a_repeated_attempt_reads_is_kept(spark, tmp_path):
    held = table(spark, tmp_path)
    for k in range(3):
        held.add(frame(spark, [("h", "a", k, str(k), k)]), k)
    # micro-batch 2 may be tried again: its merge is there, and what it was made of too
    assert held.parts() == [(0, 2)] and held.parts(2) == [(0, 0), (1, 1)]
    held.add(frame(spark, [("h", "a", 7, "again", 2)]), 2)
    assert plain(held.read()) == [("h", "a", 0, "0"), ("h", "a", 1, "1"), ("h", "a", 7, "again")]
    held.add(frame(spark, [("h", "a", 3, "3", 3)]), 3)
    assert sorted(p.name for p in (tmp_path / "rows").iterdir()) == ["0-2", "3-3"]


def test_lookup_opens_only_parts_with_the_keys(spark, tmp_path):
    import shutil

    held = table(spark, tmp_path, fan=100)
    for k in range(4):
        held.add(frame(spark, [("h", "a", 100 * k + 2 * i, f"{k}", k) for i in range(40)]), k)
    for k in (0, 1, 3):
        shutil.rmtree(tmp_path / "rows" / f"{k}-{k}")
        (tmp_path / "rows" / f"{k}-{k}").mkdir()  # a read of it would fail
        (tmp_path / "rows" / f"{k}-{k}" / "part.parquet").write_text("not parquet")
    # one key, keys beyond all numbers, another channel: nothing else is opened
    asked = [("h", "a", 220, "", 0), *(("h", "a", 1000 + i, "", 0) for i in range(50)), ("h", "b", 0, "", 0)]
    assert plain(held.lookup(frame(spark, asked))) == [("h", "a", 220, "2")]
    assert plain(held.lookup(frame(spark, asked[1:]))) == []


def test_filter_rules_out_keys_inside_the_zones(spark, tmp_path):
    held = table(spark, tmp_path, fan=100)
    held.add(spark.range(0, 20_000, 2).select(F.lit("h").alias("host"), F.lit("a").alias("source"), F.col("id").alias("number"), F.lit("v").alias("value"), F.lit(START).alias("at")), 0)
    part = spark.read.parquet(str(tmp_path / "index/0-0")).filter("_page is not null")
    assert part.count() == 5  # 16 bits a key, 32,768 bits a page
    for i, want in ((0, 0), (1, 10_000)):
        asked = spark.range(1 - i, 20_000, 2).select(F.lit("h").alias("host"), F.lit("a").alias("source"), F.col("id").alias("number"))
        assert held.lookup(asked).count() == want
    near = spark.range(1, 20_000, 2).select(F.lit("h").alias("host"), F.lit("a").alias("source"), F.col("id").alias("number"))
    part = part.select("_page", "_bits")
    pages = near.withColumn("_page", held._page(F.lit(5).cast("long"))).join(part, "_page")
    for i in range(4):
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(held._bit(i) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        pages = pages.filter(F.getbit(byte, (held._bit(i) % 8).cast("int")) == 1)
    assert pages.count() < 200  # of 10,000 that are not there


def test_rows_that_hide_older_ones_go_when_nothing_is_older(spark, tmp_path):
    held = table(spark, tmp_path, fan=2)
    keep = lambda rows, oldest: rows.filter("value <> 'gone'") if oldest else rows
    for k, value in enumerate(("x", "x", "gone", "y", "y", "y", "y", "y")):
        held.add(frame(spark, [("h", "a", 1 if value == "gone" else k, value, k)]), k, keep)
        if k >= 2:
            assert ("h", "a", 1, "x") not in plain(held.read())
    assert "gone" not in {r[3] for r in plain(held.read())}


def test_parts_without_rows_are_none(spark, tmp_path):
    held = table(spark, tmp_path)
    for k in range(4):
        held.add(frame(spark, [("h", "a", 5, "v", 0)] if k == 1 else []), k)
    assert held.parts() == [(1, 1)] and held.read().count() == 1
    nothing = table(spark, tmp_path / "none")
    assert nothing.read().count() == nothing.lookup(frame(spark, [("h", "a", 5, "v", 0)])).count() == 0


def test_writes_follow_the_batch(spark, tmp_path):
    held = table(spark, tmp_path, fan=4)
    written = []
    for k in range(17):
        held.add(frame(spark, [("h", "a", 1000 * k + i, "v" * 20, k) for i in range(50)]), k)
        new = [p for p in held._all() if p[1] == k]
        written.append(sum(spark.read.parquet(str(tmp_path / "rows" / f"{a}-{b}")).count() for a, b in new))
        assert len(held.parts()) <= 3 * 3
    assert written.count(50) == 13 and sum(written) <= 17 * 50 * 3  # each row once per level


def test_nulls_in_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), (None, 3)], "k string, v int")
    b = spark.createDataFrame([(None,)], "k string")
    assert [r.v for r in without_keys(a, b, ("k",)).collect()] == [2]
    assert sorted(r.v for r in with_keys(a, b, ("k",)).collect()) == [1, 3]
    assert sorted(map(tuple, newest(a, ("k",), "v").collect()), key=str) == sorted([("x", 2), (None, 3)], key=str)


def test_cut_tables_go_at_the_end(spark):
    import os

    with cutting(spark):
        df = cut_lineage(spark.range(3))
        (path,) = {os.path.dirname(f.removeprefix("file://")) for f in df.inputFiles()}
        with cutting(spark):
            inner = cut_lineage(spark.range(2))
            (other,) = {os.path.dirname(f.removeprefix("file://")) for f in inner.inputFiles()}
        assert not os.path.exists(other) and df.count() == 3
    assert path.startswith(shared_dir(spark)) and not os.path.exists(path)
