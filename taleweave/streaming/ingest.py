"""Streams: messages to state in micro-batches, hold-back, expiry, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import state as S

HOLD_BACK, REBUILD_EVERY = 5, 30


def settled(messages: DataFrame, hold_back: int = HOLD_BACK) -> DataFrame:
    """Messages that are at least `hold_back` behind their chat's newest."""
    newest = messages.groupBy("chat_id").agg(F.max("message_index").alias("_top"))
    return messages.join(newest, "chat_id").where(F.col("message_index") <= F.col("_top") - hold_back).drop("_top")


def every(messages: DataFrame, n: int) -> DataFrame:
    return messages.where(F.col("message_index") % n == 0)


def rebuild_points(events: DataFrame, every: int = REBUILD_EVERY) -> DataFrame:
    """chat_id, message_index at which a chat has gathered `every` more events: where arcs are built again."""
    n = F.row_number().over(Window.partitionBy("chat_id").orderBy("message_index", "id"))
    return events.withColumn("_n", n).where(F.col("_n") % every == 0).select("chat_id", "message_index")


def recent_window(messages: DataFrame, size: int = 10, chars: int = 8000) -> DataFrame:
    """For each message the names and the end of the text of the last `size` messages: a retrieval's query."""
    w = Window.partitionBy("chat_id").orderBy("message_index").rowsBetween(1 - size, 0)
    text = F.array_join(F.collect_list("mes").over(w), "\n")
    out = messages.select("chat_id", "message_index", F.array_sort(F.array_distinct(F.collect_list("name").over(w))).alias("names"), text.alias("text"))
    return out.withColumn("text", F.substring(F.col("text"), F.greatest(F.length("text") - chars + 1, F.lit(1)), F.lit(chars)))


def context_window(messages: DataFrame, around: int = 4, chars: int = 400) -> DataFrame:
    """For each message those around it, cut to `chars`; system messages don't count."""
    w = Window.partitionBy("chat_id").orderBy("message_index").rowsBetween(-around, around)
    return messages.where(~F.col("is_system")).select("chat_id", "message_index", F.array_join(F.collect_list(F.substring("mes", 1, chars)).over(w), "\n").alias("context"))


def message_rows(messages: DataFrame, least_chars: int = 80) -> DataFrame:
    """Rows for the memory table: chunks of messages that are long enough, with ids that a rerun repeats."""
    said = F.concat(F.lit(""), "name", F.lit(": "), "mes")
    rows = messages.where(~F.col("is_system")).withColumn("said", said).where(F.length("said") >= least_chars)
    rows = rows.select("chat_id", "message_index", F.posexplode(X.chunks("said")).alias("part", "content"), (F.length("said") > X.CHUNK_CHARS).alias("many"))
    key = F.concat_ws("|", "chat_id", "message_index", "part")
    return rows.select(X.content_id("mem", key).alias("id"), "chat_id", F.when(F.col("many"), "message_chunk").otherwise("message").alias("node_type"), "message_index", "content")


def quote_rows(messages: DataFrame) -> DataFrame:
    rows = messages.select("chat_id", "message_index", F.col("name").alias("speaker"), F.explode(X.quotes("mes")).alias("quote"))
    return rows.withColumn("id", X.content_id("quote", F.concat_ws("|", "chat_id", "message_index", "speaker", "quote"))).dropDuplicates(["id"])


class Store:
    """Tables as Parquet folders in a shared place; a write is a new version, named by a pointer that moves last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """Finished versions, found by the committer's marker."""
        found = self._fs.globStatus(self._path(f"{self.root}/{name}/v*/_SUCCESS"))
        return sorted(int(x.getPath().getParent().getName()[1:]) for x in found or [])

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        done = self.versions(name)
        return self.spark.read.parquet(f"{self.root}/{name}/v{done[-1]:08d}") if done else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame, keep: int = 2) -> None:
        done = self.versions(name)
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{(done[-1] if done else 0) + 1:08d}")
        for old in done[: max(0, len(done) + 1 - keep)]:
            self._fs.delete(self._path(f"{self.root}/{name}/v{old:08d}"), True)


STATE = "id long, chat_id string, key string, value string, valid_from timestamp_ntz, valid_until timestamp_ntz, source_message_index int"


def state_batches(store: Store, ttl: int = S.TTL_MESSAGES) -> Callable[[DataFrame, int], None]:
    """foreachBatch: changes (id, chat_id, key, value, valid_from, source_message_index) into the state table.

    A batch that comes again changes nothing: ids that are there are left out.
    """

    def run(batch: DataFrame, number: int) -> None:
        table = store.read("world_state", STATE)
        new = batch.dropDuplicates(["id"]).join(table.select("id"), "id", "left_anti")
        state = S.apply_changes(table, new.withColumn("valid_until", F.lit(None).cast("timestamp_ntz")))
        now = new.groupBy("chat_id").agg(F.max("source_message_index").alias("_i"), F.max("valid_from").alias("_t"))
        state = S.expire(state.join(now, "chat_id", "left"), F.col("_i"), F.col("_t"), ttl)
        store.write("world_state", state.select(*table.columns))

    return run


def start_state_stream(changes: DataFrame, store: Store, checkpoint: str, **trigger):
    return changes.writeStream.foreachBatch(state_batches(store)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def activity(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts by event type in tumbling windows, with a watermark; the same on a stream and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
