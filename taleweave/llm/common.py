"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that every contract of this package names.
SPACES = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A side is broadcast only when it has been counted and measured and has no more rows and bytes than this.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8_000_000
#: Parts that each key is dealt to where a side is too large to broadcast.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; a folder of our own serves local mode only."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="taleweave-"))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, so that a lost executor costs no recomputation."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, codec: str = "snappy", file_rows: int = 0) -> DataFrame:
    """A durable copy as a compressed table in the shared folder: for wide rows, and for row ids that must stay.

    Readers take a file's rows in batches, so very wide rows come with few rows a file.
    """
    use_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, an action's shuffle files go when it ends: for steps that leave a durable copy.  The session's own setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A durable copy of narrow rows in no more partitions than they fill: a few rows of many tasks make few files in later shuffles."""
    copy = durable(df)
    parts = max(1, -(-copy.count() // rows))
    return copy.coalesce(parts) if parts < copy.rdd.getNumPartitions() else copy


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a durable frame: eight for each number, and the length of each text or list of numbers."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        long = F.size(f.name) * 8 if kind == "array" else F.octet_length(f.name) if kind in ("string", "binary") else F.lit(0)
        size = size + 8 + F.greatest(F.coalesce(long.cast("long"), F.lit(0)), F.lit(0))
    n, total = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return n, total or 0


def join_small(rows: DataFrame, small: DataFrame, on: list[str], how: str = "left", salt: Column | None = None) -> DataFrame:
    """Join on columns without nulls.  `small` has been made durable: it is measured, and only then broadcast.

    If it is too large for that, `salt`, a whole number that tells rows with one key apart, deals a hot key's
    rows to `SALTS` parts, each with its own copy of the key's small row.
    """
    n, size = measured(small)
    if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), on, how)
    if salt is None:
        return rows.join(small, on, how)
    rows = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(copies, [*on, "_salt"], how).drop("_salt")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't among the ids (durable, no nulls); few ids are counted and broadcast, so that no text moves."""
    return join_small(docs, ids, ["doc_id"], "left_anti")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased.  `translate` looks each character up, so texts of ASCII alone, where `lower` does the same, are spared it."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def words(c: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACES), "")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts.  Null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def frugal(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The frame itself.  Its session sends at most so many rows to Python at once from here on: texts are long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > rows:
        conf.set(key, str(rows))
    return df


def small(batches, column: str, limit: int = 1_000_000):
    """The batches in slices of about `limit` bytes of a text column: what a task makes of one is soon freed."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), "int64"), 0).to_numpy(zero_copy_only=False) + 50
        start, size = 0, 0
        for i, n in enumerate(sizes):
            size += n
            if size >= limit:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def pieces(texts: list, limit: int = 1_000_000):
    """Slices (start, stop) of a list of texts with about `limit` characters each, so that a task's memory is bounded."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 50
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
