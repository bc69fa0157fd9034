"""Extractions: the record that a model returns for a batch of messages, and its way into the tables.

The order is fixed: characters, relationships, events with their chains, state (new, superseded, expired), facts and who
knows them, items, places, presence, plot threads.  Each step is a keyed merge of an exploded part, so a batch that comes
again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import models
from ..operators import state as S
from ..session import durable, stored
from ..sources import chat

RECORD = """characters array<struct<name: string, aliases: array<string>, description: string, role: string, status: string, significance: int>>,
    relationships array<struct<from: string, to: string, sentiment: double, intensity: double, description: string>>,
    events array<struct<key: string, summary: string, quote: string, participants: array<string>, location: string, significance: int, world_time: string>>,
    event_chains array<struct<from: string, to: string, type: string>>,
    world_state array<struct<key: string, value: string>>, world_state_supersede array<string>,
    knowledge_updates array<struct<character: string, content: string, domain: string>>,
    items array<struct<name: string, owner: string, location: string, status: string>>,
    locations_detail array<struct<name: string, description: string, importance: int>>,
    present array<struct<character: string, location: string>>,
    plot_threads array<struct<title: string, thread_type: string, importance: int>>, resolves_thread_ids array<string>"""
#: The tables, as an empty store has them.
TABLES = {
    "characters": "id string, chat_id string, name string, aliases array<string>, description string, role string, status string, significance int",
    "feels_about": "from_id string, to_id string, session_id string, sentiment double, intensity double, description string",
    "events": "id string, chat_id string, message_index int, summary string, source_text string, significance int, location_id string, world_time string",
    "participated_in": "character_id string, event_id string",
    "event_chains": "from_id string, to_id string, chain_type string",
    "world_state": "id long, chat_id string, key string, value string, valid_from timestamp_ntz, valid_until timestamp_ntz, source_message_index int",
    "facts": "id string, content string, domain string",
    "knows": "character_id string, fact_id string, chat_id string",
    "items": "id string, chat_id string, name string, owner_id string, location_id string, status string",
    "locations": "id string, name string, description string, importance int",
    "present_at": "character_id string, chat_id string, message_index int, location_id string, is_current boolean",
    "plot_threads": "id string, chat_id string, title string, thread_type string, importance int, resolved_at int",
}


def parse(raw: DataFrame) -> DataFrame:
    """raw: chat_id, message_index, at, reply -> the same with the record's fields; the first form of the reply that parses counts.

    Later forms are made only of replies whose earlier ones don't parse.  The record is a generator's, as a filter on it would parse once more.
    """
    forms = [F.get(F.transform(F.array(c), lambda c: F.when(c.rlike(r"^\s*\{"), F.from_json(c, RECORD))), F.lit(0)) for c in X.json_forms("reply")]
    return raw.select("chat_id", "message_index", "at", F.inline(F.array_compact(F.array(F.coalesce(*forms)))))


def _each(batch: DataFrame, field: str, *more: str) -> DataFrame:
    return batch.select("chat_id", "message_index", "at", F.posexplode(field).alias("ord", "x"), *more).where("x IS NOT NULL")


def _folded(rows: DataFrame, keys: list[str], table: str, rules: dict | None = None) -> DataFrame:
    return S.fold(rows, keys, [c.split()[0] for c in TABLES[table].split(", ")], rules)


def apply(tables: dict[str, DataFrame], batch: DataFrame, ttl: int = S.TTL_MESSAGES) -> dict[str, DataFrame]:
    """The tables after a batch of parsed records: the same as after its messages one by one, in their order.

    Rows of one key are folded by the rules of their table before they are merged; state is superseded and expires at the
    message that does it; threads are resolved only by messages that know them.
    """
    out = dict(tables)
    person = lambda c: X.chat_scoped_id(c, "chat_id")
    place = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", X.location_slug(c))

    rows = _each(batch, "characters").select("*", "x.*").where("trim(name) <> ''").withColumn("id", person("name")).withColumn("aliases", F.array_distinct(F.filter(F.coalesce("aliases", X.strings([])), lambda x: F.trim(x) != "")))
    out["characters"] = S.merge(out["characters"], _folded(rows, ["id"], "characters", S.CHARACTER_RULES), ["id"], S.CHARACTER_RULES)

    rows = _each(batch, "relationships").select("chat_id", "message_index", "ord", "x.*").withColumns({"from_id": person("from"), "to_id": person("to"), "session_id": F.col("chat_id"), "intensity": F.when(F.coalesce("intensity", F.lit(0.0)) == 0, 0.5).otherwise(F.col("intensity"))})
    out["feels_about"] = S.merge(out["feels_about"], _folded(rows, ["from_id", "to_id", "session_id"], "feels_about"), ["from_id", "to_id", "session_id"])

    events = _each(batch, "events").select("chat_id", "message_index", "ord", "x.*").where("trim(summary) <> ''")
    events = events.withColumns({"id": X.content_id("evt", F.concat_ws("|", "summary", "chat_id", "message_index")), "source_text": F.col("quote"), "location_id": place("location"), "significance": F.when(F.coalesce("significance", F.lit(0)) == 0, 3).otherwise(F.col("significance"))})
    out["events"] = S.merge(out["events"], _folded(events, ["id"], "events", S.EVENT_RULES), ["id"], S.EVENT_RULES)
    took = events.select("chat_id", F.col("id").alias("event_id"), F.explode("participants").alias("name")).where("trim(name) <> ''")
    out["participated_in"] = S.insert_new(out["participated_in"], took.select(person("name").alias("character_id"), "event_id"), ["character_id", "event_id"])
    keys = events.select("chat_id", "message_index", "key", "id").where("key IS NOT NULL").dropDuplicates(["chat_id", "message_index", "key"])
    links = _each(batch, "event_chains").select("chat_id", "message_index", F.col("x.from").alias("f"), F.col("x.to").alias("t"), F.col("x.type").alias("chain_type"))
    links = links.join(keys.select("chat_id", "message_index", F.col("key").alias("f"), F.col("id").alias("from_id")), ["chat_id", "message_index", "f"]).join(keys.select("chat_id", "message_index", F.col("key").alias("t"), F.col("id").alias("to_id")), ["chat_id", "message_index", "t"])
    out["event_chains"] = S.insert_new(out["event_chains"], links.select("from_id", "to_id", "chain_type"), ["from_id", "to_id"])

    changes = _each(batch, "world_state").select(F.xxhash64("chat_id", "message_index", "ord").alias("id"), "chat_id", "ord", "x.key", "x.value", F.col("at").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until"), F.col("message_index").alias("source_message_index"))
    changes = changes.join(out["world_state"].select("id"), "id", "left_anti")
    over = _each(batch, "world_state_supersede").select("chat_id", X.state_key("x").alias("key"), "message_index", "at")
    out["world_state"] = S.closings(S.apply_changes(out["world_state"], changes), out["world_state"], over, batch.select("chat_id", "message_index", "at"), ttl).select(*tables["world_state"].columns)

    told = _each(batch, "knowledge_updates").select("chat_id", "x.*").where("trim(content) <> ''").withColumns({"content": F.trim("content"), "domain": F.coalesce("domain", F.lit("knowledge"))}).withColumn("id", X.content_id("fact", F.concat_ws("|", "content", "domain")))
    out["facts"] = S.insert_new(out["facts"], told.select("id", "content", "domain"), ["id"])
    out["knows"] = S.insert_new(out["knows"], told.select(person("character").alias("character_id"), F.col("id").alias("fact_id"), "chat_id"), ["character_id", "fact_id", "chat_id"])

    rows = _each(batch, "items").select("chat_id", "message_index", "ord", "x.*").where("trim(name) <> ''").withColumns({"id": X.content_id("item", F.concat_ws("|", F.regexp_replace(X.slug("name"), "^chr-", ""), "chat_id")), "owner_id": F.when(F.col("owner").isNotNull(), person("owner")), "location_id": place("location")})
    out["items"] = S.merge(out["items"], _folded(rows, ["id"], "items", S.ITEM_RULES), ["id"], S.ITEM_RULES)

    rows = _each(batch, "locations_detail").select("chat_id", "message_index", "ord", "x.*").withColumn("id", place("name")).where("id IS NOT NULL")
    out["locations"] = S.merge(out["locations"], _folded(rows, ["id"], "locations", S.LOCATION_RULES), ["id"], S.LOCATION_RULES)

    rows = _each(batch, "present").select("chat_id", "message_index", "ord", person("x.character").alias("character_id"), F.col("x.location").alias("l")).withColumns({"location_id": place("l"), "is_current": F.lit(True)})
    out["present_at"] = S.arrivals(out["present_at"], _folded(rows, ["character_id", "chat_id", "message_index"], "present_at"))

    rows = _each(batch, "plot_threads").select("chat_id", "message_index", "ord", "x.*").withColumns({"id": X.content_id("plot", F.concat_ws("|", "chat_id", "title")), "resolved_at": F.lit(None).cast("int")})
    threads = S.merge(out["plot_threads"], _folded(rows, ["id"], "plot_threads", S.PLOT_RULES), ["id"], S.PLOT_RULES)
    born = rows.groupBy("id", "chat_id").agg(F.min("message_index").alias("_b")).join(out["plot_threads"].select("id"), "id", "left_anti")
    said = _each(batch, "resolves_thread_ids").select(F.col("x").alias("id"), "chat_id", "message_index").join(born, ["id", "chat_id"], "left")
    done = said.where("_b IS NULL OR message_index >= _b").groupBy("id", "chat_id").agg(F.min("message_index").alias("_m"))
    threads = threads.join(done, ["id", "chat_id"], "left").withColumn("resolved_at", F.coalesce("resolved_at", "_m"))
    out["plot_threads"] = threads.select(*tables["plot_threads"].columns)
    return out


def bulk(tables: dict[str, DataFrame], messages: DataFrame, generate, at, size: int = 10, ttl: int = S.TTL_MESSAGES) -> dict[str, DataFrame]:
    """The tables after all messages of all chats: generate(prompt) is called for every `size` of a chat, in parallel.

    The replies are kept before they are applied, in the order of their messages, so that no call is made twice.
    A group whose call fails after its retries changes nothing; `failed` has its chat_id, message_index and error, as has a
    group whose reply holds no record.  at: the time of writing, a column.
    """
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["name"], F.lit(": "), m["mes"])), "\n")
    asked = chat.batches(messages, size).select("chat_id", F.col("batch").alias("message_index"), said.alias("prompt"))
    found = durable(models.replies(asked, "prompt", generate).withColumn("at", at))
    records = durable(parse(found.where("error IS NULL")))
    unread = found.join(records.select("chat_id", "message_index"), ["chat_id", "message_index"], "left_anti")
    failed = unread.select("chat_id", "message_index", F.coalesce("error", F.lit("no record in the reply")).alias("error"))
    return apply(tables, records, ttl) | {"failed": failed}


def batches(store, extractor, ttl: int = S.TTL_MESSAGES):
    """foreachBatch over messages: extractor(messages) gives chat_id, message_index, at, reply; tables get new versions."""

    def run(messages: DataFrame, number: int) -> None:
        tables = {name: store.read(name, schema) for name, schema in TABLES.items()}
        for name, rows in apply(tables, stored(parse(extractor(messages))), ttl).items():
            store.write(name, rows)

    return run
