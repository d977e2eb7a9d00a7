"""Divergence of sources, language model and periodic runs against plain versions, and the cases they must survive."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import brute
from llm.test_operators import SCHEMA, odd_rows
from wardlake.llm import bloom_lm, divergence, periodic
from wardlake.llm.queries import QUERIES
from wardlake.llm.shared import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return Scratch(spark, "test").write(spark.createDataFrame(odd_rows(), SCHEMA).repartition(3), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return Scratch(spark, "test").write(spark.createDataFrame([], SCHEMA), "empty")


# --- periodic runs ---------------------------------------------------------------


def test_runs_of_random_sequences():
    rng = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(0, 5)):
            letters = rng.choice((1, 2, 3, 9))
            x = [rng.randrange(letters) for _ in range(rng.randint(0, 70))]
            if x and rng.random() < 0.6:
                period, a = rng.randint(1, 9), rng.randrange(len(x))
                x = [c if i < a else x[a + (i - a) % period] for i, c in enumerate(x) if i < a or a + (i - a) % period < len(x)]
                x += [rng.randrange(letters) for _ in range(rng.choice((0, 8)))]
            texts.append(x)
        first = np.cumsum([0, *map(len, texts)])
        got = periodic.find_runs(np.array([c for x in texts for c in x], dtype=np.int64), first)
        want = [(s + first[d], s + n + first[d], q) for d, x in enumerate(texts) for s, n, q in brute.runs(x)]
        assert got.tolist() == [list(map(int, r)) for r in want]


def test_rules_are_looked_at_in_small_parts(monkeypatch):
    x = np.array([*([1, 2, 3] * 40), *range(10, 60), *([7] * 90), *([4, 4, 5] * 30)])
    want = periodic.find_runs(x, np.array([0, len(x)])).tolist()
    monkeypatch.setattr(periodic, "CHUNK_PERIODS", 3)
    assert periodic.find_runs(x, np.array([0, len(x)])).tolist() == want
    assert [0, 120, 3] in want and [170, 260, 1] in want


def test_one_word_a_million_times():
    (row,) = periodic._results([[b"word"] * 1_000_000])
    assert row["runs"] == [{"start": 0, "length": 1_000_000, "period": 1}] and row["collapsed"] == "word"


def test_runs_of_odd_rows(spark, odd, empty):
    docs = odd.withColumn("runs", F.lit("mine")).withColumn("collapsed", F.col("text"))
    got = periodic.with_runs(docs, "collapsed").collect()
    assert len(got) == len(odd_rows())
    for r in got:
        words = brute.words(r.text)
        runs = brute.runs(words) if len(words) < 1000 else []
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == runs
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (r.strongest and tuple(r.strongest)) == best
    assert {r.collapsed for r in got if r.doc_id == 17} == {"word"}
    assert periodic.with_runs(empty).count() == 0


def test_op13(spark):
    got = {r.doc_id: r for r in QUERIES["op13_repair_runs"](spark, SF).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert set(got) == {d for d, _ in rows}
    planted = 0
    for d, text in rows:
        words, h = brute.words(text), zlib.crc32(str(d).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        if n > 3000:
            continue
        runs = brute.runs(words)
        inside = {i for s, m, q in runs for i in range(s + q, s + m)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in inside)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        r = got[d]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
    assert planted > 5


def test_planting_with_null_and_empty(spark, odd):
    rows = odd.select("doc_id", "text", periodic.planted(F.col("text"), F.col("doc_id")).alias("new")).collect()
    assert all(r.new == (r.text or "") for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10)


# --- language model ----------------------------------------------------------------


def test_levels():
    assert bloom_lm.level(np.array([0, 1, 2, 8, 9, 10, 11])).tolist()[:4] == [0, 1, 2, 8]
    for c in (1, 5, 40, 1000, 10**9):
        assert abs(bloom_lm.VALUES[bloom_lm.level(np.array([c]))[0]] / c - 1) < 0.13


def test_packed_numbers():
    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (bloom_lm.unpacked_keys(bloom_lm.packed_keys(x)) == x).all() and len(bloom_lm.unpacked(bloom_lm.packed(x[:0]))) == 0


def model_rows(spark, docs, **how):
    scores, n = bloom_lm.score_documents(docs, F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True)), **how)
    return sorted(scores.collect(), key=str), n


def test_model_of_odd_rows(spark, odd, empty, monkeypatch):
    """Small chunks and parts; levels that the filter gives too high are rare, none is too low."""
    monkeypatch.setattr(bloom_lm, "BITS", 40)  # read by workers only through the segments' sizes
    rows = [(d, t, d is None or d % 3 != 0) for d, t, *_ in odd_rows()]
    want = brute.bigram_model([r[1:] for r in rows], lambda c: bloom_lm.level(np.array([c]))[0], lambda q: bloom_lm.VALUES[q], prior=bloom_lm.PRIOR)
    got, n = model_rows(spark, odd)
    assert n == sum(w[0] for w, r in zip(want, rows, strict=True) if r[2])
    want = sorted(((d, learnt, *w) for (d, _, learnt), w in zip(rows, want, strict=True)), key=lambda r: (str(r[0]), r[2], r[4]))
    got = sorted(got, key=lambda r: (str(r.id), r.n_tokens, r.base_score))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:4] == w[:4]
        assert g.base_score == pytest.approx(w[4]) and g.score == pytest.approx(w[5], rel=0.01)
    assert model_rows(spark, empty) == ([], 0)


def test_both_ways_to_probe_give_the_same(spark, odd, monkeypatch):
    for name, value in (("CHUNK_BYTES", 5000), ("PART_WORDS", 500), ("SEGMENT_GRAMS", 700)):
        monkeypatch.setattr(bloom_lm, name, value)
    for order in (1, 2, 3):
        near, far = model_rows(spark, odd, order=order), model_rows(spark, odd, order=order, broadcast_bytes=0)
        assert near == far


def test_nothing_learnt(spark, odd):
    scores, n = bloom_lm.score_documents(odd, F.lit(False))
    rows = scores.collect()
    assert n == 0 and len(rows) == len(odd_rows()) and all(r.n_known == 0 and r.score == 0.0 for r in rows)


def test_op12(spark):
    got = {r.doc_id: r for r in QUERIES["op12_bloom_lm"](spark, SF).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    want = brute.bigram_model([(t, not held[d]) for d, t in rows], lambda c: bloom_lm.level(np.array([c]))[0], lambda q: bloom_lm.VALUES[q], prior=bloom_lm.PRIOR)
    n = sum(w[0] for (d, _), w in zip(rows, want, strict=True) if not held[d])
    for (d, _), w in zip(rows, want, strict=True):
        g = got[d]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[d], w[0], w[1], n)
        assert g.base_score == pytest.approx(w[2]) and g.score == pytest.approx(w[3], rel=0.02)
    out = [got[d] for d, _ in rows if held[d]]
    assert sum(g.score for g in out) > sum(g.base_score for g in out)  # context helps on texts that were held out


# --- divergence of sources ---------------------------------------------------------


def rows_of(df):
    return {tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()}


def test_divergence_of_random_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 7)
    rng = random.Random(5)
    words = ["the", "The", "of", "é", "Éa", "x-ray", "a1b", "naïve", "word", "漢字"]
    rows = [(rng.choice(("en", "de", None, "")), rng.choice(("a", "b", "ñ", "s 1", None)), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(90)]
    rows += [("fr", "only", "un deux"), ("it", "x", None), ("it", "y", "uno"), *[rows[0]] * 12]
    docs = spark.createDataFrame([(i % 7, t, a, b, 0) for i, (a, b, t) in enumerate(rows)], SCHEMA).repartition(4)
    got = rows_of(divergence.divergence(docs, min_docs=3, top=4))
    assert got == brute.divergence(rows, 3, 4)
    assert ("it", "x", "pair", "y", 0, 1) in got  # no term is kept there


def test_tree_shares_paths_and_may_be_cut():
    rng = random.Random(8)
    rows = [(sorted((s, rng.randint(1, 4), 1) for s in rng.sample(range(1, 7), rng.randint(1, 6))), rng.randint(1, 3)) for _ in range(60)]

    def sums(*groups):
        out = {}
        for group in groups:
            tree = divergence.PatternTree()
            for items, times in group:
                tree.insert([(s, 10 * n, 10) for s, n, _ in items], times)
            assert len(tree.parent) <= 1 + sum(len(i) for i, _ in group)
            for a, b, v in zip(*(x.tolist() for x in tree.folded()), strict=True):
                out[a, b] = out.get((a, b), 0) + v
        return out

    assert sums(sorted(rows)) == sums(rows[:20], rows[20:]) != {}
    assert divergence.PatternTree().folded()[0].tolist() == []


def test_divergence_of_odd_rows(spark, odd, empty):
    rows = [(lang, source, t) for _, t, lang, source, _ in odd_rows()]
    assert rows_of(divergence.divergence(odd, min_docs=2)) == brute.divergence(rows, 2, 10)
    assert rows_of(divergence.divergence(empty)) == set()


def test_op11(spark):
    rows = duckdb.sql(f"SELECT lang, source, text FROM '{SF}/documents.parquet'").fetchall()
    assert rows_of(QUERIES["op11_pattern_tree"](spark, SF)) == brute.divergence(rows, 10, 10)
