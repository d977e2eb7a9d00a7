"""Registered queries of the corpus operators over the given tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import bloom_lm, bpe, curves, digest_index, divergence, jaccard, line_spread, nbsvm, packing, periodic, pii, sharding, substring, tokens
from wardlake.llm.shared import Scratch, table
from wardlake.llm.words import NO_KEY

SEQUENCE = 2048
#: The key of the pseudonyms; a deployment passes its own.
PSEUDONYM_KEY = "wardlake corpus key 1"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        return f

    return keep


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = SEQUENCE, **memo) -> DataFrame:
    """Pieces of all documents with their sequence and place in it; ``memo`` goes to ``tokens.pieces``."""
    path = public_tokenizers.path("word_bpe_49k.json")
    cut = tokens.pieces(docs, path, capacity, **memo).withColumn("item", F.monotonically_increasing_id())
    cut = Scratch(spark, "pieces").write(cut, "pieces")
    placed = packing.pack(cut.select("item", F.col("length").alias("size")), capacity)
    return cut.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _held_out(key: str):
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> nbsvm.Model:
    return nbsvm.train(docs, table(spark, sf_dir, "labels"), ~_held_out("doc_id"))


@query("op3_quality_nbsvm")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = nbsvm.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_two_pass_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("record.text", F.lit(""))
    return sharding.shard_rows(docs, 16).select(
        "record.doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_feistel_pseudonyms")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and how many values were replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", pii.pseudonymised(F.col("text"), PSEUDONYM_KEY).alias("x"))
    return docs.select("doc_id", "x.text", "x.n_replaced")


@query("op6_digest_index")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger ids are ingested first, so the row with the largest id of equal texts stays."""
    scratch = Scratch(spark, "digests")
    rows = scratch.write(digest_index.digests(table(spark, sf_dir, "documents")), "rows")
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    middle = (low + high) // 2 if low is not None else 0
    upper = F.coalesce(F.col("key") > middle, F.lit(False))
    index = digest_index.DigestIndex.open(spark, f"{scratch.path}/index", int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = digest_index.deduplicate(index, [rows.filter(upper), rows.filter(~upper)])
    return out.select(F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op7_doubling_windows")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


@query("op8_jaccard_tiles")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    groups = jaccard.link_groups(docs, n=3, percent=90, every_row=True)
    null = lambda c: F.when(F.col(c) != NO_KEY, F.col(c))
    return groups.select(null("doc").alias("doc_id"), "n_shingles", null("component").alias("component_id"))


@query("op9_hilbert_windows")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


@query("op10_line_spread")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on five sources or more go, but for their first place; the text left is given by its digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_spread.remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op13_repair_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.with_runs(docs)
    line = lambda r: F.concat(F.array_join(F.array(r["start"], r["length"], r["period"]), ","), F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length DIV strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


@query("op12_bloom_lm")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    scores, n = bloom_lm.score_documents(table(spark, sf_dir, "documents"), ~held_out)
    return scores.select(
        F.col("id").alias("doc_id"),
        (~F.col("trained")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@query("op11_pattern_tree")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))
