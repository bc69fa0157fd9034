"""Point of view: what a character can know, and the mask that it puts on a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def universe(tables, ids: list[str], chat: str, up_to: int | None = None) -> dict[str, DataFrame]:
    """Frames of ids: events (took part, or was where and when it happened), indices, facts, locations, items, characters."""
    capped = lambda rows: rows if up_to is None else rows.where(F.col("message_index").isNull() | (F.col("message_index") <= up_to))
    here = capped(tables("story_events").where(F.col("chat_id") == chat)).select("id", "message_index", "location_id", "chat_id")
    took = tables("participated").where(F.col("character_id").isin(ids)).select(F.col("event_id").alias("id"))
    was = tables("present_at").where(F.col("character_id").isin(ids)).select("location_id", "chat_id").distinct()
    events = here.join(took, "id", "left_semi").unionByName(here.join(was, ["location_id", "chat_id"], "left_semi").select(*here.columns)).distinct()
    people = tables("participated").join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi").select(F.col("character_id").alias("id")).distinct()
    items = tables("items").where((F.col("chat_id") == chat) | F.col("chat_id").isNull()).where(F.col("owner_id").isin(ids)).select("id")
    return {
        "events": events.select("id"),
        "indices": events.select("message_index").where("message_index IS NOT NULL").distinct(),
        "facts": tables("knows").where(F.col("character_id").isin(ids) & ((F.col("chat_id") == chat) | F.col("chat_id").isNull())).select(F.col("fact_id").alias("id")).distinct(),
        "locations": events.select(F.col("location_id").alias("id")).where("id IS NOT NULL").unionByName(was.where(F.col("chat_id") == chat).select(F.col("location_id").alias("id"))).distinct(),
        "items": items.distinct(),
        "characters": people,
    }


def mask_hits(hits: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """Hits (kind, id, message_index) that the character can know: events by id, the rest by index."""
    events = hits.where("kind = 'event'").join(known["events"], "id", "left_semi")
    others = hits.where("kind <> 'event'").join(known["indices"], "message_index", "left_semi")
    return events.unionByName(others.select(*events.columns))


def mask_events(events: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """Events at known indices; those without an index stay."""
    return events.join(known["indices"], "message_index", "left_semi").select(*events.columns).unionByName(events.where(F.col("message_index").isNull()))
