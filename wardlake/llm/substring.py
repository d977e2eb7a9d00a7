"""Repeated word windows removed by level-wise doubling.

A window of ``width`` words is removed if its word sequence also starts earlier
(smaller key, or same document and earlier start). Windows are not compared all
with all lengths: half-width sequences come first, and only what repeats there
is extended to full width.

1. Every window is represented by its anchor, the half-width sequence in it with
   the smallest hash. Equal windows have equal anchors, so counting anchors
   (about a fifth of the words) finds every half-width candidate; an anchor seen
   once ends the search for all its windows.
2. Places of repeated anchors are extended to all windows that share the anchor,
   as one sequence. Of equal extensions only the first place can hold a first
   window: the others are removed as a whole, whatever their number. Groups of
   copies collapse here, combined before the shuffle.
3. Where one anchor still has different extensions, the full-width windows of
   the first places are compared themselves.

Extensions and windows are 128-bit hashes. A document is (key, hash of its
text): rows with equal key and equal text are one document and get the same
result. NULL keys sort first, NULL texts have no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.shared import Scratch
from wardlake.llm.words import NO_KEY, Words, binary_column, chunks, in_parts, keyed, list_column, signed, texts_of, unpacked

WIDTH = 20


def _anchors(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per run of windows with one anchor: text, anchor place, first and last window start, anchor hash (places in the batch)."""
    half = width // 2
    n, span = len(words.hash), width - half + 1
    none = np.zeros(0, dtype=np.int64)
    if n < width:
        return none, none, none, none, np.zeros(0, dtype=np.uint64)
    grams = words.spans(np.arange(n - half + 1), np.arange(n - half + 1) + half)
    # smallest of `span` neighbours by doubling, the left one of equals
    best, reach = np.arange(len(grams)), 1
    while reach < span:
        step = min(reach, span - reach)
        a, b = best[:-step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        reach += step
    starts = np.arange(n - width + 1)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    ok = text[: n - width + 1] == text[width - 1 :]
    starts, anchor = starts[ok], best[: n - width + 1][ok]
    owner = text[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    tail = tail[: len(head)]
    return owner[head], anchor[head], starts[head], starts[tail], grams[anchor[head]]


def _scan(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc, dh, n_words, and per anchor run: hash and place in the document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for lo, hi, values, offsets in chunks(binary_column(batch, "text")):
                w = Words(values, offsets)
                owner, anchor, _, _, h = _anchors(w, width)
                counts = np.bincount(owner, minlength=hi - lo)
                columns = [keys.slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(w.first).astype(np.int64)), list_column(signed(h), counts), list_column((anchor - w.first[owner]).astype(np.int32), counts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "dh", "n_words", "h", "place"])

    return keyed(docs, key, text).mapInArrow(work, "doc long, dh long, n_words long, h array<long>, place array<int>")


RUNS = "array<struct<h: long, e1: long, e2: long, place: int, lo: int, hi: int>>"


def _extended(hits: DataFrame, width: int) -> DataFrame:
    """doc, dh, ztext and, for each repeated anchor, the sequence of all windows that share it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in in_parts(batch):
                wanted = part.column(part.schema.get_field_index("places")).to_pylist()
                owner, anchor, first, last, h = _anchors(w, width)
                base = w.first[owner]
                place = anchor - base
                want = np.concatenate([(np.int64(i) << 32) | np.array(sorted(set(p)), dtype=np.int64) for i, p in enumerate(wanted)])
                ok = np.isin((owner.astype(np.int64) << 32) | place, want)
                owner, place, first, last, h, base = owner[ok], place[ok], first[ok], last[ok], h[ok], base[ok]
                e1, e2 = w.pair(first, last + width)
                # the anchor's distance from the first window belongs to the extension
                off = (place - (first - base)).astype(np.uint64)
                e1 = e1 ^ (off * np.uint64(0x9E3779B97F4A7C15))
                fields = [signed(h), signed(e1), signed(e2), place.astype(np.int32), (first - base).astype(np.int32), (last - base).astype(np.int32)]
                runs = pa.StructArray.from_arrays([pa.array(f) for f in fields], ["h", "e1", "e2", "place", "lo", "hi"])
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(wanted))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)], ["doc", "dh", "ztext", "runs"])

    return hits.select("doc", "dh", "ztext", "places").mapInArrow(work, f"doc long, dh long, ztext binary, runs {RUNS}")


def _windows(texts: DataFrame, width: int) -> DataFrame:
    """w1, w2, doc, dh, start of every full-width window in the given ranges."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in in_parts(batch):
                spans = part.column(part.schema.get_field_index("spans")).to_pylist()
                starts = [w.first[i] + np.unique(np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in spans[i]])) for i in range(len(spans))]
                counts = [len(s) for s in starts]
                at = np.concatenate(starts)
                owner = np.repeat(np.arange(len(spans)), counts)
                w1, w2 = w.pair(at, at + width)
                part = part.take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([pa.array(signed(w1)), pa.array(signed(w2)), part.column(0), part.column(1), pa.array((at - w.first[owner]).astype(np.int32))], ["w1", "w2", "doc", "dh", "start"])

    return texts.select("doc", "dh", "ztext", "spans").mapInArrow(work, "w1 long, w2 long, doc long, dh long, start int")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc, dh, ztext, gone (array of word ranges lo to hi, without hi) of the documents that lose words."""
    scratch = Scratch(docs.sparkSession, "substring")
    places = _scan(docs, key, text, width).select("doc", "dh", F.explode(F.arrays_zip("h", "place")).alias("x")).select("x.h", "doc", "dh", "x.place")
    often = scratch.write(places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "anchors")
    hits = scratch.write(places.join(often, "h", "left_semi").groupBy("doc", "dh").agg(F.collect_set("place").alias("places")), "hits")
    # one row for repeated rows; the join has dealt the rows by this key already
    texts = texts_of(docs, key, text, hits).join(hits, ["doc", "dh"]).dropDuplicates(["doc", "dh"])
    cand = scratch.write(_extended(texts, width), "extended")
    runs = cand.select("doc", "dh", F.explode("runs").alias("r")).select("doc", "dh", "r.*")
    here = F.struct("doc", "dh", "place")
    groups = runs.groupBy("h", "e1", "e2").agg(F.min(here).alias("first"), F.count("*").alias("n"))
    groups = scratch.write(groups, "groups")
    copies = runs.join(groups.filter("n > 1").select("h", "e1", "e2", "first"), ["h", "e1", "e2"]).filter(here != F.col("first"))
    copies = copies.select("doc", "dh", F.col("lo"), (F.col("hi") + width).alias("hi"))
    # anchors with more than one extension: their first places are compared window by window
    several = groups.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("h")
    firsts = groups.join(several, "h", "left_semi").select("first.*").distinct()
    spans = runs.select("doc", "dh", "place", "lo", "hi").join(firsts, ["doc", "dh", "place"], "left_semi")
    spans = spans.groupBy("doc", "dh").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    windows = scratch.write(_windows(cand.select("doc", "dh", "ztext").join(spans, ["doc", "dh"]), width), "windows")
    start = F.struct("doc", "dh", "start")
    again = windows.groupBy("w1", "w2").agg(F.min(start).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = windows.join(again.select("w1", "w2", "first"), ["w1", "w2"]).filter(start != F.col("first"))
    later = later.select("doc", "dh", F.col("start").alias("lo"), (F.col("start") + width).alias("hi"))
    gone = copies.unionByName(later).groupBy("doc", "dh").agg(F.collect_set(F.struct("lo", "hi")).alias("gone"))
    return scratch.write(cand.select("doc", "dh", "ztext").join(gone, ["doc", "dh"]), "gone")


CLEANED = "doc_id long, n_words long, n_removed long, kept_text binary"


def _kept(raw: bytes, gone: list[dict]) -> tuple[int, int, bytes]:
    words = raw.split()
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for g in gone:
        drop[g["lo"]] += 1
        drop[g["hi"]] -= 1
    out = np.cumsum(drop)[:-1] > 0
    return len(words), int(out.sum()), b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, of every row.

    ``digest`` gives kept_sha256 in place of the words themselves.
    """
    gone = repeated_spans(docs, key, text, width)

    def named(row: tuple) -> bytes:
        return hashlib.sha256(row).hexdigest().encode() if digest else row

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            rows = [_kept(raw, g) for raw, g in zip(unpacked(batch), batch.column(3).to_pylist(), strict=True)]
            n, removed, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(map(named, kept), pa.binary())], ["doc", "dh", "n_words", "n_removed", "kept"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, offsets in chunks(binary_column(batch, "text")):
                split = [values[a:b].tobytes().split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                kept = [named(b" ".join(x)) for x in split]
                counts = pa.array([len(x) for x in split], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), counts, pa.array(kept, pa.binary())], ["doc", "dh", "n_words", "kept"])

    new = gone.select("doc", "dh", "ztext", "gone").mapInArrow(changed, "doc long, dh long, n_words long, n_removed long, kept binary")
    old = keyed(docs, key, text).mapInArrow(plain, "doc long, dh long, n_words long, kept binary")
    new = new.select("doc", "dh", "n_removed", F.col("kept").alias("left"))
    out = old.join(new, ["doc", "dh"], "left")
    name = F.coalesce("left", "kept").cast("string")
    return out.select(
        F.when(F.col("doc") != NO_KEY, F.col("doc")).alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        name.alias("kept_sha256" if digest else "kept_text"),
    )
