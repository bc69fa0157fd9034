"""A session with the settings that the library's results rest on."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "taleweave", master: str | None = None, **settings) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder.  The cluster names it in spark.checkpoint.dir; one of our own serves local mode only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.conf.get("spark.checkpoint.dir", None) and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="taleweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Inside, an action's shuffle files go when it ends.  The session's own setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def durable(df: DataFrame) -> DataFrame:
    """A copy in the shared checkpoint folder: lineage is cut, and a lost executor costs no recomputation."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A durable copy as a compressed table: for many rows that are read more than once, a few columns at a time."""
    path = f"{_shared(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
