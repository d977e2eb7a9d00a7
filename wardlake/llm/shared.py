"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wardlake.session import shared_dir


class Scratch:
    """A folder of one run below ``spark.checkpoint.dir``.

    A table written here has no lineage: losing an executor costs a read of the
    file, never a recomputation that might number rows in another way.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str, *partition: str) -> DataFrame:
        """The rows as a Parquet table of this run, read back with their own schema."""
        at = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition) if partition else writer).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        """Delete one table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of whole texts that go to a Python worker at once; long texts make large batches.
TEXT_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches for texts in place of Spark's 10,000 rows; a smaller setting of the session stands."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_BATCH:
        spark.conf.set(name, str(TEXT_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
