"""From raw documents to packed training sequences.

Five stages, each written as Parquet and read again as the next one's input:
quality classifier, line dedup, near-duplicate join, pseudonyms, packing. All
but the last return the columns of ``documents``; texts changed by one stage are
what the next one sees (``n_chars`` follows the text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import jaccard, line_spread, nbsvm, pii
from wardlake.llm.queries import PSEUDONYM_KEY, pack_documents, quality_model
from wardlake.llm.shared import Scratch, small_batches, table
from wardlake.llm.words import NO_KEY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now; a NULL text has none."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; fitted on the labelled rows of the corpus it is given."""
    small_batches(spark)
    model = quality_model(spark, docs, sf_dir)
    return nbsvm.score(docs, model).filter(F.col("score") >= 0.5).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sources are left in their first place only; every document stays."""
    small_batches(spark)
    return _measured(line_spread.remove_boilerplate(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one whose id is the group's smallest.

    Repeated rows, and equal texts without an id, are one document, and one row
    of it stays. Documents without words are like no other, so all of them stay.
    """
    small_batches(spark)
    groups = Scratch(spark, "near").write(jaccard.link_groups(docs, n=5, percent=80, every_row=True), "groups")
    place = ["doc", "dh"]
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_KEY)).alias("doc")
    rows = docs.select(*COLUMNS, own, F.xxhash64(F.coalesce("text", F.lit(""))).alias("dh"))
    rows = rows.join(groups.filter("not kept").select(place).distinct(), place, "left_anti")
    again = groups.filter("kept and n_shingles > 0").groupBy(place).agg(F.count("*").alias("rows")).filter("rows > 1").select(place)
    again = Scratch(spark, "near").write(again, "again")
    if again.isEmpty():
        return rows.select(COLUMNS)
    # the smallest of equal rows, combined before the shuffle: a document that is there very often is no task's work
    copies = rows.join(again, place, "left_semi").groupBy(place).agg(F.min(F.struct("doc_id", "source", "lang", "n_chars", "text")).alias("row"))
    return rows.join(again, place, "left_anti").select(COLUMNS).unionByName(copies.select("row.*").select(COLUMNS))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values give way to pseudonyms of their format."""
    small_batches(spark)
    return _measured(docs.withColumn("text", pii.pseudonymised(F.col("text"), PSEUDONYM_KEY)["text"]))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    small_batches(spark)
    # the same workers serve other stages, so they hold little and give it back after each task
    return pack_documents(spark, docs, memo_words=200_000, keep_model=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("packing", packed),
]

#: Classifier, pseudonyms and packing cannot be written in SQL; tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
