"""Lines that stand on many sites, by HyperLogLog sketches with an exact second look.

Every line is a 128-bit hash. One aggregation builds a HyperLogLog sketch of the
sites of each line, combined before the shuffle. Lines whose estimate lies
within ``band`` of the threshold get an exact distinct count; the others are
decided by the sketch. A boilerplate line is removed wherever it stands, except
for its first place (smallest key, then smallest line number), so no content
disappears from the corpus altogether.

A line ends at a line feed and is compared without leading and trailing blanks;
blank lines are never removed. A NULL text stays NULL, a NULL site counts as one
site of its own, a NULL key sorts first. Rows with equal key and equal text are
one document: each gets the same result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.llm.shared import Scratch

MIN_SITES = 5
LG_K = 10
#: Four standard errors of a sketch with 2**LG_K registers.
BAND = 4 * 1.04 / math.sqrt(2**LG_K)


def _doc(key: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(F.lit(5), F.col(text)).alias("doc_hash")]


def document_lines(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """doc, doc_hash, pos, h1, h2, site of every line that is not blank; the texts stay behind."""
    parts = F.transform(F.split(F.col(text), "\n", -1), lambda line: F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")))
    hashed = F.transform(parts, lambda line, i: F.struct(i.alias("pos"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"), (line != "").alias("full")))
    where = F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("")))
    lines = docs.select(*_doc(key, text), where.alias("site"), F.explode(F.filter(hashed, lambda x: x["full"])).alias("x"))
    return lines.select("doc", "doc_hash", "site", "x.pos", "x.h1", "x.h2")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """h1, h2 and the first place of each line on at least ``min_sites`` sites; written once."""
    scratch = Scratch(lines.sparkSession, "line-spread")
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("about"),
        F.min(F.struct("doc", "doc_hash", "pos")).alias("first"),
    )
    spread = scratch.write(spread.filter(F.col("about") >= min_sites * (1 - band)), "candidates")
    near = spread.filter(F.col("about") <= min_sites * (1 + band))
    sites = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = sites.groupBy("h1", "h2").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    sure = spread.filter(F.col("about") > min_sites * (1 + band)).select("h1", "h2", "first")
    return scratch.write(sure.unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first")), "boilerplate")


def remove_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The rows with boilerplate lines taken out of ``text``; adds n_lines and n_removed (names that clash are replaced)."""
    lines = document_lines(docs, key, text, site)
    found = boilerplate(lines, min_sites)
    hits = lines.join(found, ["h1", "h2"])
    hits = hits.filter(F.struct("doc", "doc_hash", "pos") != F.col("first")).select("doc", "doc_hash", "pos").distinct()
    gone = hits.groupBy("doc", "doc_hash").agg(F.collect_list("pos").alias("gone"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(F.struct(*columns).alias("row"), *_doc(key, text))
    joined = keyed.join(gone, ["doc", "doc_hash"], "left").select("row", "gone")
    out = joined.select(
        *[(_kept(F.col("row")[text], F.col("gone")) if c == text else F.col("row")[c]).alias(c) for c in columns],
        F.coalesce(F.size(F.split(F.col("row")[text], "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return out


def _kept(text: Column, gone: Column) -> Column:
    # untouched texts stay in the JVM
    return F.when(gone.isNull(), text).otherwise(_without(F.when(gone.isNotNull(), text), gone))


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for t, g in zip(text.to_pylist(), gone.to_pylist(), strict=True):
        drop = set(g or ())
        out.append(t if t is None or not drop else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop))
    return pa.array(out, pa.string())
