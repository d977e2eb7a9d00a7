"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution is part of the design: it coalesces small shuffle
#: partitions, splits skewed join partitions and turns a join into a broadcast
#: once the measured size of a side is below the threshold.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "wardlake", **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Event times are naive wall-clock values; reading them as UTC keeps them unchanged."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and state, as named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset
    and everything runs in one process (tests, local runs) a folder of our own is
    made and remembered; on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    own = tempfile.mkdtemp(prefix="wardlake-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_cuts = threading.local()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back.

    A lost executor then costs a read instead of the whole computation, and
    whoever uses the rows twice does not compute them twice. Inside ``cutting``
    the folder is deleted at its end; elsewhere it is the caller's to clear.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut/{uuid.uuid4().hex}"
    if getattr(_cuts, "paths", None) is not None:
        _cuts.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cutting(spark: SparkSession) -> Iterator[None]:
    """Tables cut by this thread inside the block are deleted when it is left, so use its results inside."""
    outer, _cuts.paths = getattr(_cuts, "paths", None), []
    try:
        yield
    finally:
        mine, _cuts.paths = _cuts.paths, outer
        for path in mine:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is; none there is no error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, none where it does not exist."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []


def make_folder(spark: SparkSession, path: str) -> None:
    """A folder that is there already is left alone."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
