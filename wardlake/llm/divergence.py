"""How far sources of one language differ in their words: all pairs of sources, and the words behind it.

Every term a language keeps (``MIN_DOCS`` documents of it have it) has a rate in
each of its sources, and two sources differ by the sum of f over all kept terms,

    p = 1 + floor(SCALE * (count + 2) / (N + 2 * V))        f = floor((p - q)**2 / (p + q)),

zero counts included. Most counts are zero, so the sum is taken as what it would be
if all were, plus a correction for every count of one source alone and a correction
for every two counts of a term. The last ones come from a frequent-pattern tree: a
term is a row of (source, count) items in a fixed order of sources, equal rows are
one row with a multiplicity, and rows with a common beginning share its path. Each
node is paired with its ancestors once, for all terms below it.

The rows are sorted over the whole cluster, so a task holds neighbouring branches; a
task folds its tree whenever it has ``TREE_NODES`` nodes and starts another one,
which only costs a shared path. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.shared import Scratch
from wardlake.llm.words import binary_column

MIN_DOCS, SCALE, TOP_TERMS = 10, 1_000_000_000, 10
#: Different terms a task counts before it passes their counts on; nodes it holds before it folds its tree.
HELD_TERMS, TREE_NODES = 400_000, 200_000

_TO_TERMS = bytearray(range(256))
for _b in range(128):
    _c = chr(_b)
    _TO_TERMS[_b] = ord(_c.lower()) if _c.isalpha() else 32
_TO_TERMS = bytes(_TO_TERMS)

COUNTED = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each term of each (lang, source), counted per task; parts may repeat.

    Terms are runs of letters, where every character beyond ASCII is a letter, and
    only A to Z are lower-cased. A row with the term '' stands for the group itself.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_) in held.items():
                terms = list(n)
                arrays = [
                    pa.array([lang], pa.string()).take(pa.array(np.zeros(len(terms), dtype=np.int32))),
                    pa.array([source], pa.string()).take(pa.array(np.zeros(len(terms), dtype=np.int32))),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(n.values(), pa.int64()),
                    pa.array([docs_[t] for t in terms], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, text in zip(keys, binary_column(batch, "text"), strict=True):
                if key not in held:
                    held[key] = Counter({b"": 0}), Counter()
                    size += 1
                n, docs_ = held[key]
                before = len(n)
                own = Counter(text.as_py().translate(_TO_TERMS).split())
                n.update(own)
                docs_.update(own.keys())
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from passed_on()
                    size = 0
        yield from passed_on()

    empty = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    return docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(work, COUNTED)


def _rate(count: Column, total: Column, terms: Column) -> Column:
    """p; decimals, because SCALE * count may pass 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * wide(count + 2)
    return F.when(total + 2 * terms > 0, F.call_function("div", top, wide(total + 2 * terms)) + 1).cast("long")


def _spread(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


# --- the tree ------------------------------------------------------------------


class PatternTree:
    """Rows of items as paths; a node knows its parent, its item and how many terms pass through it."""

    def __init__(self) -> None:
        self.parent, self.item, self.count = [-1], [(-1, 0, 0)], [0]
        self.below: list[dict] = [{}]

    def insert(self, items: list[tuple[int, int, int]], times: int) -> None:
        node = 0
        for item in items:
            step = self.below[node].get(item)
            if step is None:
                step = self.below[node][item] = len(self.parent)
                self.parent.append(node)
                self.item.append(item)
                self.count.append(0)
                self.below.append({})
            node = step
            self.count[node] += times

    def folded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of one source, of the other, sum of the corrections of their common terms).

        An item is (place of the source, p, p of a zero count there). All nodes
        climb together, so a step is one pass of numpy over the tree.
        """
        parent, times = np.array(self.parent), np.array(self.count, dtype=np.int64)
        place, p, zero = (np.array(x, dtype=np.int64) for x in zip(*self.item, strict=True))
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        node = np.arange(1, len(parent))
        above = parent[node]
        lows, highs, sums = [], [], []
        while len(node := node[keep := above > 0]):
            above = above[keep]
            both = f(p[node], p[above]) - f(p[node], zero[above]) - f(zero[node], p[above]) + f(zero[node], zero[above])
            key = place[above] * (1 << 31) + place[node]
            names, of = np.unique(key, return_inverse=True)
            total = np.zeros(len(names), dtype=np.int64)
            np.add.at(total, of, both * times[node])
            lows.append(names >> 31)
            highs.append(names & ((1 << 31) - 1))
            sums.append(total)
            above = parent[above]
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) if x else none for x in (lows, highs, sums))


def _tree_sums(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value) parts from sorted rows (lang, path, times)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = PatternTree(), None

        def folded() -> pa.RecordBatch:
            a, b, value = tree.folded()
            langs = pa.array([of], pa.string()).take(pa.array(np.zeros(len(a), dtype=np.int32)))
            return pa.RecordBatch.from_arrays([langs, pa.array(a), pa.array(b), pa.array(value)], ["lang", "a", "b", "value"])

        for batch in batches:
            for lang, path, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if of is not None and (lang != of or len(tree.parent) > TREE_NODES):
                    yield folded()
                    tree = PatternTree()
                of = lang
                tree.insert([(x["place"], x["p"], x["zero"]) for x in path], times)
        if of is not None:
            yield folded()

    return rows.mapInArrow(work, "lang string, a long, b long, value long")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    ``pair``: every other source of the lang, most different first. ``term``: the
    ``top`` terms a source has more often than its lang as a whole. NULL lang,
    source and text are ''. A group without kept terms has all counts 0; in a lang
    without kept terms all pairs have the value 0. Every row of ``docs`` is a
    document, repeated rows too; columns other than lang, source and text are not
    read. Equal values go by the item. An empty table gives no rows.

    Memory: the sources of a lang that have one term lie in one row; there are at
    most as many as a group has rows in the result.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    # dealt by term once: sums of a group and of a term need no second shuffle
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("counts"))
    terms = scratch.write(terms.filter((F.col("docs") >= min_docs) | (F.col("term") == "")), "terms")
    kept = terms.filter("term <> ''")
    items = kept.select("lang", "term", "all", F.explode("counts").alias("x")).select("lang", "term", "all", "x.source", "x.n")

    langs = terms.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v"), F.sum("all").alias("lang_n"))
    sums = items.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    groups = terms.filter("term = ''").select("lang", F.explode("counts.source").alias("source"))
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang")
    groups = groups.withColumns({"total": F.coalesce("total", F.lit(0)), "used": F.coalesce("used", F.lit(0))})
    # sources with many terms come first in a path, where they are shared
    order = Window.partitionBy("lang").orderBy(F.desc("used"), "source")
    zero = _rate(F.lit(0).cast("long"), F.col("total"), F.col("v"))
    groups = scratch.write(groups.withColumns({"place": F.row_number().over(order).cast("long"), "zero": zero}), "groups")

    rates = items.join(groups, ["lang", "source"]).withColumn("p", _rate(F.col("n"), F.col("total"), F.col("v")))
    rates = scratch.write(rates.select("lang", "source", "term", "place", "p", "zero", _rate(F.col("all"), F.col("lang_n"), F.col("v")).alias("q")), "rates")

    own = rates.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _spread(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    own = ranked(own).filter(F.col("rank") <= top)

    paths = rates.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("place", "p", "zero"))).alias("path"))
    paths = scratch.write(paths.groupBy("lang", "path").agg(F.count("*").alias("times")), "paths")
    both = _tree_sums(paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path"))

    here = groups.select("lang", F.col("place").alias("a"), F.col("zero").alias("za"), "v")
    there = groups.select("lang", F.col("place").alias("b"), F.col("zero").alias("zb"))
    # a count of one source against the zero counts of every other one
    levels = rates.groupBy("lang", "place", "p", "zero").agg(F.count("*").alias("times")).withColumnRenamed("place", "a")
    alone = levels.join(there, "lang").filter("a <> b")
    alone = alone.withColumn("value", F.col("times") * (_spread(F.col("p"), F.col("zb")) - _spread(F.col("zero"), F.col("zb"))))
    alone = alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    nothing = here.join(there, "lang").filter("a < b").select("lang", "a", "b", F.coalesce(F.col("v") * _spread(F.col("za"), F.col("zb")), F.lit(0)).alias("value"))
    pairs = scratch.write(nothing.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    pairs = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    named = lambda c, name: groups.select("lang", F.col("place").alias(c), F.col("source").alias(name))
    pairs = pairs.join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"])
    pairs = ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pairs.unionByName(own)
