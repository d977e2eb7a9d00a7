"""Exact duplicates against a persistent digest index.

The index is a Parquet table bucketed by the digest and sorted inside the
buckets. New data is reduced to one row per digest before it is shuffled,
sort-merge anti-joined with the index, and what is new is appended. Texts are
compared after lower-casing A-Z; NULL counts as empty, so NULL and empty texts
are equal. Of one batch the row with the largest key stays (NULL keys are
smallest; of fully repeated rows one stays); a text that is in the index
already keeps none of the batch.
"""

from __future__ import annotations

import string
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm.shared import Scratch


def normalised(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``digest`` (32 bytes) and ``row``, a number within this batch; write it before use."""
    return docs.select(F.col(key).alias("key"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))


@dataclass(frozen=True)
class DigestIndex:
    """Digest, key of the row that stayed; one row per text ever seen."""

    spark: SparkSession
    table: str

    @staticmethod
    def open(spark: SparkSession, location: str, buckets: int) -> DigestIndex:
        """The index in a folder, made if it is not there; the bucket count of an index never changes."""
        table = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        return DigestIndex(spark, table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Add a batch of ``digests`` rows; returns the new texts: digest, keep_id, keep_row, written."""
        groups = batch.groupBy("digest").agg(F.max(F.struct("key", "row")).alias("keep"))
        groups = groups.select("digest", F.col("keep.key").alias("keep_id"), F.col("keep.row").alias("keep_row"))
        new = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        new = Scratch(self.spark, "digest-batch").write(new, "new")
        new.select("digest", "keep_id").write.insertInto(self.table)
        return new


def deduplicate(index: DigestIndex, batches: list[DataFrame]) -> DataFrame:
    """One row per row of the batches: key, digest, keep_id, group_size, kept.

    Batches are ingested in the given order and join their decisions on the
    digest; a digest with very many rows is split by the adaptive skew join.
    """
    spark = index.spark
    kept = None
    for k, batch in enumerate(batches):
        new = index.ingest(batch).withColumn("batch", F.lit(k))
        kept = new if kept is None else kept.unionByName(new)
    rows = None
    for k, batch in enumerate(batches):
        part = batch.withColumn("batch", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    # a digest of an earlier ingest is in the index only
    known = index.rows().join(kept.select("digest", "keep_row", "batch"), "digest", "left").join(sizes, "digest")
    known = known.withColumnsRenamed({"batch": "keep_batch"})
    known = Scratch(spark, "digest-known").write(known, "known")
    joined = rows.join(known, "digest")
    mine = (F.col("row") == F.col("keep_row")) & (F.col("batch") == F.col("keep_batch"))
    return joined.select("key", "digest", "keep_id", "group_size", F.coalesce(mine, F.lit(False)).alias("kept"))
