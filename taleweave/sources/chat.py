"""Chat files, lorebooks and other inputs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

MESSAGE = "name string, is_user boolean, is_system boolean, mes string, swipe_id int, swipes array<string>, send_date string, character_name string, user_name string"
LOREBOOK = "entries map<string, struct<disable: boolean, content: string, comment: string, key: array<string>>>"


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """Every line of chat files: chat_id (the file), line (from 0), is_header, malformed, and the record.

    Lines keep the order of their file because a file is split within its row, not over tasks.
    """
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("chat_id"), F.posexplode(F.split("value", "\n")).alias("line", "raw")).where(F.trim("raw") != "")
    r = F.from_json("raw", MESSAGE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = files.withColumn("r", r).withColumn("malformed", F.col("r").isNull() | F.col("r._bad").isNotNull())
    swiped = F.when(F.col("r.swipe_id") >= 0, F.nullif(F.get("r.swipes", F.col("r.swipe_id")), F.lit("")))
    return rows.select("chat_id", "line", (F.col("line") == 0).alias("is_header"), "malformed", "r.name", "r.is_user", "r.is_system", F.coalesce(swiped, "r.mes").alias("mes"), "r.send_date", "r.character_name", "r.user_name")


def messages(lines: DataFrame) -> DataFrame:
    """The messages of read_chats with their index: no header, system messages, blanks or malformed lines."""
    kept = lines.where(~F.col("is_header") & ~F.col("malformed") & ~F.coalesce("is_system", F.lit(False)) & (F.coalesce("mes", F.lit("")) != ""))
    order = Window.partitionBy("chat_id").orderBy("line")
    return kept.select("chat_id", (F.row_number().over(order) - 1).alias("message_index"), "name", F.coalesce("is_user", F.lit(False)).alias("is_user"), F.lit(False).alias("is_system"), "mes", "send_date")


def chat_list(lines: DataFrame, ingestion: DataFrame | None = None) -> DataFrame:
    """chat_id, date, messages (lines but the header), and the ingestion status if there is one."""
    out = lines.groupBy("chat_id").agg((F.count(F.lit(1)) - 1).alias("messages")).withColumn("date", F.nullif(X.file_date("chat_id"), F.lit("")))
    return out if ingestion is None else out.join(ingestion.select("chat_id", "status"), "chat_id", "left")


def batches(messages: DataFrame, size: int = 10) -> DataFrame:
    """chat_id, batch (its first index), messages in order.  0 means 10; a negative size means 1."""
    n = max(1, int(size or 10))
    columns = [c for c in messages.columns if c not in ("chat_id", "message_index")]
    grouped = messages.groupBy("chat_id", (F.floor(F.col("message_index") / n) * n).cast("int").alias("batch"))
    return grouped.agg(F.array_sort(F.collect_list(F.struct("message_index", *columns))).alias("messages"))


def corpus(messages: DataFrame) -> DataFrame:
    """One text for each chat: `[name]: text` of its messages, a blank line between."""
    said = F.concat(F.lit("["), "name", F.lit("]: "), "mes")
    grouped = messages.where(~F.col("is_system")).groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("message_index", said.alias("said")))).alias("all"))
    return grouped.select("chat_id", F.array_join(F.transform("all", lambda x: x["said"]), "\n\n").alias("corpus"))


def read_lorebook(spark: SparkSession, path: str) -> DataFrame:
    """uid, comment, keys, content, domain, person, place of entries that are neither disabled nor blank."""
    entries = spark.read.schema(LOREBOOK).json(path, multiLine=True).select(F.explode("entries").alias("uid", "e"))
    kept = entries.where(~F.coalesce("e.disable", F.lit(False)) & (F.trim(F.coalesce("e.content", F.lit(""))) != ""))
    rows = kept.select("uid", F.coalesce("e.comment", F.lit("")).alias("comment"), F.coalesce("e.key", F.expr("cast(array() as array<string>)")).alias("keys"), F.trim(X.fill_template("e.content")).alias("content"))
    return rows.withColumns({"domain": X.lore_domain("comment", F.col("keys"), "content"), "person": X.lore_character(F.col("comment"), "content"), "place": X.lore_location(F.col("comment"), F.col("keys"), "content")})


def list_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """path, length, modified: a listing without the contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def sample_chunks(text: str, count: int, size: int = 1000, seed: int = 42) -> list[tuple[int, str]]:
    """Non-overlapping random stretches of one text, by a seeded generator; ten attempts for each wanted."""
    from ..functions.random import Mulberry32

    draw, taken = Mulberry32(seed), []
    for _ in range(10 * count):
        if len(taken) == count or len(text) <= size:
            break
        at = int(draw() * (len(text) - size))
        if all(abs(at - other) >= size for other in taken):
            taken.append(at)
    return [(a, text[a : a + size]) for a in sorted(taken)]
