"""Structured reads: relationships, timeline, knowledge, state, places, traits, and the panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import scope


def _in(rows: DataFrame, chats, column: str = "chat_id", open_scope: bool = False) -> DataFrame:
    """Scoped rows.  Without a scope: none, or all where the read is open."""
    names = scope(chats)
    return rows.where(F.col(column).isin(names)) if names else rows if open_scope else rows.where(F.lit(False))


def relationships(feels: DataFrame, characters: DataFrame, ids: list[str], chats=None, limit: int = 20) -> DataFrame:
    """The strongest feelings that touch the characters; of all sessions without a scope."""
    rows = _in(feels, chats, "session_id", True).where(F.col("from_id").isin(ids) | F.col("to_id").isin(ids))
    top = rows.orderBy(F.col("intensity").desc_nulls_last(), "from_id", "to_id", "session_id").limit(limit)
    name = lambda key, to: characters.select(F.col("id").alias(key), F.col("name").alias(to))
    return top.join(name("from_id", "from_name"), "from_id").join(name("to_id", "to_name"), "to_id")


def recent_events(events: DataFrame, participated: DataFrame, characters: DataFrame, chats, limit: int = 8) -> DataFrame:
    """The first events of the timeline, with who took part.  Names are looked up for these rows only."""
    top = _in(events, chats).orderBy(F.col("world_time").isNull(), "world_time", "message_index", "id").limit(limit)
    names = participated.withColumnRenamed("event_id", "id").join(F.broadcast(top.select("id")), "id", "left_semi").join(characters.select(F.col("id").alias("character_id"), "name"), "character_id").groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("participants"))
    return top.join(names, "id", "left").withColumn("participants", F.coalesce("participants", F.expr("cast(array() as array<string>)")))


def known_facts(knows: DataFrame, facts: DataFrame, ids: list[str], chats, limit: int = 20) -> DataFrame:
    rows = _in(knows, chats).where(F.col("character_id").isin(ids)).select("character_id", "fact_id").distinct()
    r = F.row_number().over(Window.partitionBy("character_id").orderBy("fact_id"))
    return rows.withColumn("r", r).where(F.col("r") <= limit).drop("r").join(facts.withColumnRenamed("id", "fact_id"), "fact_id")


def unknown_facts(knows: DataFrame, facts: DataFrame, ids: list[str], chats, limit: int = 10) -> DataFrame:
    """Secrets and backstories that someone in scope knows and the character knows in no chat."""
    hidden = facts.where(F.col("domain").isin("secret", "backstory")).join(_in(knows, chats).select(F.col("fact_id").alias("id")), "id", "left_semi").withColumnRenamed("id", "fact_id")
    pairs = hidden.withColumn("character_id", F.explode(F.array(*[F.lit(i) for i in ids])))
    pairs = pairs.join(knows.select("character_id", "fact_id"), ["character_id", "fact_id"], "left_anti")
    r = F.row_number().over(Window.partitionBy("character_id").orderBy("fact_id"))
    return pairs.withColumn("r", r).where(F.col("r") <= limit).drop("r")


def world_state(state: DataFrame, chats=None, limit: int = 20) -> DataFrame:
    return _in(state, chats, open_scope=True).where(F.col("valid_until").isNull()).orderBy(F.col("valid_from").desc_nulls_last(), F.desc("id")).limit(limit)


def plot_threads(threads: DataFrame, chats, limit: int = 20) -> DataFrame:
    return _in(threads, chats).where(F.col("resolved_at").isNull()).orderBy(F.col("importance").desc_nulls_last(), "id").limit(limit)


def snapshots(rows: DataFrame, locations: DataFrame, chats, limit: int = 3) -> DataFrame:
    top = _in(rows, chats).orderBy(F.col("message_index").desc_nulls_last(), "id").limit(limit)
    return top.join(locations.select(F.col("id").alias("location_id"), F.col("name").alias("location_name")), "location_id", "left")


def current_places(present_at: DataFrame, characters: DataFrame, locations: DataFrame, recent: DataFrame, ids: list[str] | DataFrame, chats) -> DataFrame:
    """name, location of the characters (a list, or rows of id), only of those present lately (recent: name) if anyone was."""
    rows = _in(present_at, chats).where("is_current")
    if isinstance(ids, DataFrame):
        rows = rows.join(ids.select(F.col("id").alias("character_id")), "character_id", "left_semi")
    else:
        rows = rows.where(F.col("character_id").isin(ids))
    rows = rows.join(characters.select(F.col("id").alias("character_id"), "name"), "character_id").join(locations.select(F.col("id").alias("location_id"), F.col("name").alias("location")), "location_id")
    names = recent.select(F.lower(F.trim("name")).alias("n")).where("n <> ''").distinct()
    seen = rows.join(names, F.lower("name") == F.col("n"), "left_semi")
    anyone = names.limit(1).select(F.lit(1).alias("one"))
    return seen.unionByName(rows.join(anyone, F.lit(True), "left_anti")).select("name", "location", "chat_id").distinct()


def visible_traits(traits: DataFrame, ids: list[str], chats=None, persona: list[str] = ()) -> DataFrame:
    """Canonical traits of which the row or a merged wording is of the scope (or of none), and the persona's."""
    names = scope(chats)
    mine = traits.where(F.col("character_id").isin(ids))
    roots = mine.where(F.col("canonical_id").isNull())
    if names:
        seen = mine.where(F.col("source_chat").isin(names) | F.col("source_chat").isNull()).select(F.coalesce("canonical_id", "id").alias("id")).distinct()
        roots = roots.join(seen, "id", "left_semi")
    pool = traits.where(F.col("canonical_id").isNull() & F.col("character_id").isin(list(persona)))
    return roots.withColumn("pool", F.lit("chat")).unionByName(pool.withColumn("pool", F.lit("persona")))


def panel_stats(ids: list[str], participated: DataFrame, events: DataFrame, feels: DataFrame, items: DataFrame, chats=None) -> DataFrame:
    """One row: events, feelings, items, last_seen; of all chats without a scope.  Four small aggregates, no fan-out."""
    own = participated.where(F.col("character_id").isin(ids)).select(F.col("event_id").alias("id")).distinct()
    e = _in(events, chats, open_scope=True).join(own, "id", "left_semi").agg(F.count("*").alias("events"), F.max("message_index").alias("last_seen"))
    f = _in(feels, chats, "session_id", True).where(F.col("from_id").isin(ids)).agg(F.count("*").alias("feelings"))
    i = _in(items, chats, open_scope=True).where(F.col("owner_id").isin(ids)).agg(F.count("*").alias("items"))
    return e.crossJoin(f).crossJoin(i)  # one row each


def panel_events(ids: list[str], participated: DataFrame, events: DataFrame, limit: int = 5, chats=None) -> DataFrame:
    rows = _in(events, chats, open_scope=True).join(participated.where(F.col("character_id").isin(ids)).withColumnRenamed("event_id", "id"), "id")
    return rows.orderBy(F.col("message_index").desc_nulls_last(), F.col("ts").desc_nulls_last(), "id", "character_id").limit(min(20, max(1, int(limit or 5))))


def panel_relations(ids: list[str], feels: DataFrame, characters: DataFrame, chats=None) -> DataFrame:
    """Outbound feelings; without a scope the latest session's for each target."""
    rows = _in(feels, chats, "session_id", True).where(F.col("from_id").isin(ids))
    if not scope(chats):
        rows = rows.groupBy("to_id").agg(F.max(F.struct("session_id", "from_id", "sentiment", "intensity")).alias("m")).select("to_id", "m.*")
    return rows.join(characters.select(F.col("id").alias("to_id"), F.col("name").alias("to_name")), "to_id")


def chats(ingestion: DataFrame, events: DataFrame) -> DataFrame:
    both = ingestion.select("chat_id", F.lit(None).cast("timestamp_ntz").alias("at")).unionByName(events.groupBy("chat_id").agg(F.max("ts").alias("at")))
    return both.groupBy("chat_id").agg(F.max("at").alias("last_event")).orderBy(F.col("last_event").desc_nulls_last(), "chat_id")


def known_entities(characters: DataFrame, present_at: DataFrame, locations: DataFrame, items: DataFrame, threads: DataFrame, knows: DataFrame, state: DataFrame, chat: str, index: int | None = None) -> dict[str, DataFrame]:
    """What an extraction prompt is told: frames of names, places, items, threads, facts and state with its age."""
    seen = present_at.where(F.col("chat_id") == chat).groupBy("character_id", "location_id").agg(F.max("message_index").alias("last"))
    latest = seen.groupBy("character_id").agg(F.max("last").alias("last")).join(characters.withColumnRenamed("id", "character_id"), "character_id")
    names = latest.select("last", "character_id", F.posexplode(F.array("name", "alias")).alias("p", "form")).groupBy("form").agg(F.min(F.struct((-F.col("last")).alias("l"), "character_id", "p")).alias("o"))
    places = seen.groupBy("location_id").agg(F.max("last").alias("last")).join(locations.withColumnRenamed("id", "location_id"), "location_id")
    now = state.where((F.col("chat_id") == chat) & F.col("valid_until").isNull())
    r = F.row_number().over(Window.partitionBy("character_id").orderBy("fact_id"))
    return {
        "characters": names.orderBy("o.l", "o.character_id", "o.p").limit(50).select("form"),
        "locations": places.orderBy(F.desc("last"), "location_id").limit(50).select("location_id", "name"),
        "items": items.where(F.col("chat_id") == chat).orderBy(F.col("significance").desc_nulls_last(), "id").limit(50).select("id", "name"),
        "threads": plot_threads(threads, chat, 20).select("id", "title"),
        "facts": knows.where(F.col("chat_id") == chat).withColumn("r", r).where("r <= 10").select("character_id", "fact_id"),
        "state": now.orderBy(F.col("valid_from").desc_nulls_last(), F.desc("id")).limit(30).select("key", "value", (F.lit(index) - F.col("source_message_index")).alias("age")),
    }
