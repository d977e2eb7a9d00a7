"""Runs of repeated words: stretches of a text that repeat themselves at once.

A run is a stretch of consecutive words with smallest period q, at least
``max(MIN_WORDS, MIN_EXPONENT * q)`` words long, that no neighbouring word
extends. They are found on a grammar of the text (Larsson and Moffat's Re-Pair
over word ids): every rule joins two neighbouring parts, and a run is seen in
whole where the boundary of such a join lies inside it and the run inside the
joined part. So each rule is looked at once, however often the text uses it, its
runs are written at all places where the rule stands, and of the pieces that lie
one inside the other the maximal ones stay.

A document is worked on alone, whole, in memory that grows with its own words;
the documents of a batch only share the numpy calls.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.llm.words import binary_column, mix

#: Shortest run in words, and in periods.
MIN_WORDS, MIN_EXPONENT = 6, 4
#: Words worked on together, unless one document alone has more.
CHUNK_WORDS = 200_000
#: Candidate periods looked at in one numpy call, unless one rule alone has more.
CHUNK_PERIODS = 2_000_000

_BASE = 0x9E3779B97F4A7C15


class _Spans:
    """Hashes of all stretches of a sequence of ids; equal stretches hash alike."""

    def __init__(self, ids: np.ndarray):
        steps = []
        for x in (_BASE, pow(_BASE, -1, 2**64)):
            power = np.full(len(ids) + 1, x, dtype=np.uint64)
            power[0] = 1
            steps.append(np.cumprod(power))
        self.total = np.zeros(len(ids) + 1, dtype=np.uint64)
        np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * steps[0][:-1], out=self.total[1:])
        self.inverse = steps[1]

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether [a, a + n) and [b, b + n) hash alike."""
        return (self.total[a + n] - self.total[a]) * self.inverse[a] == (self.total[b + n] - self.total[b]) * self.inverse[b]

    def reach(self, at: np.ndarray, step: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``at`` on (before it, if ``back``) equal those ``step`` later, ``room`` at most."""
        low, high = np.zeros_like(room), room.copy()
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            start = at - middle if back else at
            good = self.same(start, start + step, middle)
            low = np.where(good, middle, low)
            high = np.where(good, high, np.where(open_, middle - 1, high))
        return low


class _Rules:
    """Joins of one round: ``of`` numbers the rule of each place, ``left`` and ``size`` are per rule, in words."""

    def __init__(self, place: np.ndarray, of: np.ndarray, left: np.ndarray, size: np.ndarray):
        order = np.argsort(of, kind="stable")
        self.place, self.left, self.size = place[order], left, size
        self.begin = np.searchsorted(of[order], np.arange(len(left) + 1))


def _pair_rounds(ids: np.ndarray, doc: np.ndarray) -> tuple[list[_Rules], np.ndarray, np.ndarray]:
    """Rules of Re-Pair per document, and the places and sizes of the symbols that are left.

    In each round every pair that is the most frequent one among those it overlaps
    is replaced, so the most frequent pair of a document always is. A pair that
    occurs once is never looked at again unless a neighbour changes.
    """
    n = len(ids)
    symbol, size = np.append(ids, -1), np.ones(n + 1, dtype=np.int64)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    ends = np.flatnonzero(doc[1:] != doc[:-1]) if n else np.zeros(0, dtype=np.int64)
    after[ends] = n
    before[ends + 1] = n
    if n:
        before[0] = n
    rank = np.zeros(n + 1, dtype=np.int64)
    used = np.ones(n + 1, dtype=bool)
    used[n] = False
    fresh = int(ids.max()) + 1 if n else 0
    live, rounds = np.flatnonzero(after[:n] < n), []
    while len(live):
        wide = np.int64(fresh)
        key = (doc[live] * wide + symbol[live]) * wide + symbol[after[live]]
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        count = np.diff(np.append(start, len(key)))
        number = np.empty(len(key), dtype=np.int64)
        number[order] = np.repeat(np.arange(len(start)), count)
        often = count[number] > 1
        at, pair = live[often], number[often]
        if not len(at):
            break
        mine = count[pair] * np.int64(len(start) + 1) + pair
        rank[at] = mine
        # places of one pair that overlap (a a a): every other one from the first
        linked = np.concatenate(([False], (before[at[1:]] == at[:-1]) & (mine[1:] == mine[:-1])))
        index = np.arange(len(at))
        odd = (index - np.maximum.accumulate(np.where(linked, 0, index))) % 2 == 1
        taken = ~odd & (rank[before[at]] <= mine) & (rank[after[at]] <= mine)
        place, chosen = at[taken], pair[taken]
        names, of = np.unique(chosen, return_inverse=True)
        second = after[place]
        first_of = np.zeros(len(names), dtype=np.int64)
        first_of[of] = place
        left = size[first_of].copy()
        rounds.append(_Rules(place, of, left, left + size[after[first_of]]))
        rank[at] = 0
        size[place] += size[second]
        symbol[place] = fresh + of
        fresh += len(names)
        used[second] = False
        after[place] = after[second]
        before[after[place]] = place
        before[n] = n
        live = np.unique(np.concatenate((place, before[place], at)))
        live = live[used[live]]
        live = live[after[live] < n]
    heads = np.flatnonzero(used[:n])
    return rounds, heads, size[heads]


def _tree_rounds(heads: np.ndarray, size: np.ndarray, doc: np.ndarray) -> Iterator[_Rules]:
    """What Re-Pair leaves of each document, joined two by two up to its whole text."""
    while len(heads):
        own = doc[heads]
        first = np.concatenate(([True], own[1:] != own[:-1]))
        index = np.arange(len(heads))
        even = (index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0
        joined = np.flatnonzero(even[:-1] & (own[1:] == own[:-1]))
        if not len(joined):
            return
        left, right = size[joined], size[joined + 1]
        yield _Rules(heads[joined], np.arange(len(joined)), left, left + right)
        size = size.copy()
        size[joined] += right
        heads, size = heads[even], size[even]


def _crossing(rules: _Rules, ids: np.ndarray, spans: _Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rule, begin and end within it, period) of the runs across the boundary of each rule, looked at in its first place.

    Such a run has two whole periods on one side, so there the words next to the
    boundary stand twice.
    """
    found = []
    for side in (0, 1):
        reach = np.minimum((rules.size - rules.left if side else rules.left) // 2, rules.size // MIN_EXPONENT)
        reach[rules.size < MIN_WORDS] = 0
        todo = np.flatnonzero(reach)
        share = np.cumsum(reach[todo]) // CHUNK_PERIODS
        for part in np.split(todo, np.flatnonzero(np.diff(share)) + 1):
            if not len(part):
                continue
            rule = np.repeat(part, reach[part])
            period = np.arange(1, len(rule) + 1) - np.repeat(np.cumsum(reach[part]) - reach[part], reach[part])
            border = rules.place[rules.begin[rule]] + rules.left[rule]
            anchor = border if side else border - period
            near = border if side else border - 1
            good = ids[near] == ids[near + period if side else near - period]
            rule, period, anchor = rule[good], period[good], anchor[good]
            start = anchor if side else anchor - period
            good = spans.same(start, start + period, period)
            found.append((rule[good], period[good], anchor[good]))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 4
    rule, period, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    low = rules.place[rules.begin[rule]]
    high = low + rules.size[rule]
    begin = anchor - spans.reach(anchor, period, anchor - low, back=True)
    end = anchor + period + spans.reach(anchor, period, high - anchor - period, back=False)
    long = end - begin >= np.maximum(MIN_WORDS, MIN_EXPONENT * period)
    rule, begin, end, period = rule[long], (begin - low)[long], (end - low)[long], period[long]
    # multiples of a period give the same stretch: the smallest counts
    order = np.lexsort((period, end, begin, rule))
    rule, begin, end, period = rule[order], begin[order], end[order], period[order]
    new = np.ones(len(rule), dtype=bool)
    new[1:] = (rule[1:] != rule[:-1]) | (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    return rule[new], begin[new], end[new], period[new]


def find_runs(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (begin, end, period) of all runs of the texts [first[d], first[d + 1]) of word ids, by place, then period."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ids = ids.astype(np.int64)
    spans = _Spans(ids)
    rounds, heads, size = _pair_rounds(ids, doc)
    parts = []
    for rules in [*rounds, *_tree_rounds(heads, size, doc)]:
        rule, begin, end, period = _crossing(rules, ids, spans)
        many = rules.begin[rule + 1] - rules.begin[rule]
        which = np.repeat(np.arange(len(rule)), many)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        place = rules.place[rules.begin[rule[which]] + nth]
        parts.append(np.stack((place + begin[which], place + end[which], period[which]), axis=1))
    rows = np.concatenate(parts) if parts else np.zeros((0, 3), dtype=np.int64)
    # a piece inside a stretch of the same period belongs to it
    rows = rows[np.lexsort((-rows[:, 1], rows[:, 0], rows[:, 2]))]
    wide = np.int64(len(ids) + 1)
    furthest = rows[:, 2] * wide + rows[:, 1]
    if len(rows):
        before = np.concatenate(([-1], np.maximum.accumulate(furthest)[:-1]))
        rows = rows[furthest > before]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _is_run(ids: np.ndarray, low: int, high: int, begin: int, end: int, period: int) -> bool:
    """The stretch compared word by word, its neighbours too."""
    if not np.array_equal(ids[begin : end - period], ids[begin + period : end]):
        return False
    return (begin == low or ids[begin - 1] != ids[begin - 1 + period]) and (end == high or ids[end] != ids[end - period])


STRETCH = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(STRETCH)), ("strongest", STRETCH), ("collapsed", pa.string())])
_STRETCH = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RESULT_FIELDS = {
    "n_words": T.StructField("n_words", T.LongType()),
    "runs": T.StructField("runs", T.ArrayType(_STRETCH)),
    "strongest": T.StructField("strongest", _STRETCH),
    "collapsed": T.StructField("collapsed", T.StringType()),
}


def _chunks(texts: Iterator[bytes]) -> Iterator[list[list[bytes]]]:
    """Words of consecutive texts, some ``CHUNK_WORDS`` at a time."""
    held, n = [], 0
    for text in texts:
        words = text.split()  # of bytes: space and 9 to 13
        if held and n + len(words) > CHUNK_WORDS:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield held


def _results(texts: list[list[bytes]]) -> Iterator[dict]:
    flat = [w for words in texts for w in words]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
    first = np.concatenate(([0], np.cumsum([len(w) for w in texts]))).astype(np.int64)
    rows = find_runs(ids, first)
    bounds = np.searchsorted(rows[:, 0], first)
    for d, words in enumerate(texts):
        low, n = int(first[d]), len(words)
        mine = rows[bounds[d] : bounds[d + 1]].tolist()
        if not all(_is_run(ids, low, low + n, *r) for r in mine):
            raise ArithmeticError("two different word sequences have the same hash")
        kept = words
        if mine:
            steps = np.zeros(n + 1, dtype=np.int64)
            for begin, end, period in mine:
                steps[begin + period - low] += 1
                steps[end - low] -= 1
            kept = [w for w, inside in zip(words, np.cumsum(steps[:-1]).tolist(), strict=True) if not inside]
        runs = [{"start": b - low, "length": e - b, "period": p} for b, e, p in mine]
        best = max(runs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None)
        yield {"n_words": n, "runs": runs, "strongest": best, "collapsed": b" ".join(kept).decode()}


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``runs`` (start, length, period; by start, then period), ``strongest`` and ``collapsed``.

    ``strongest`` is the run with the greatest length / period, compared exactly;
    of equal ones the first, then the one with the smaller period; NULL without
    runs. ``collapsed`` is the text whose runs keep their first period only, words
    joined by one space. A NULL text is empty: no words, no runs, collapsed ''.
    Every row comes back with its own result, repeated rows too; columns of these
    four names that ``docs`` has already are replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in RESULT_FIELDS]
    rows = docs.select(*[docs[f.name] for f in kept], docs[text].cast("string").alias("_text_"))
    schema = T.StructType([*kept, *RESULT_FIELDS.values()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                texts = (x.as_py() for x in binary_column(some, "_text_"))
                made = pa.array([r for chunk in _chunks(texts) for r in _results(chunk)], RESULT)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *made.flatten()], schema.names)

    return rows.mapInArrow(work, schema)


def planted(text: Column, doc_id: Column) -> Column:
    """Texts of every tenth document (by the hash of its id) with a repeated ending; a NULL id plants nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(x: Column) -> Column:
        n = F.size(x).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        made = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(x, place(i).cast("int")))
        return F.when(n > 0, F.array_join(made, " ")).otherwise("")

    # bound once: the words are split once however often they are looked at
    changed = F.element_at(F.transform(F.array(words), repeated), 1)
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), changed).otherwise(F.coalesce(text, F.lit("")))
