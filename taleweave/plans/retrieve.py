"""The retrieval: scope, mentions, structured reads, hybrid search, surroundings, point of view, text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pov, reads, search
from ..session import durable, stored
from . import render


@dataclass
class Request:
    chats: list[str]
    query: str = ""
    vector: list[float] | None = None
    names: list[str] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    persona: list[str] = field(default_factory=list)
    profile: str = "inject"
    overrides: dict | None = None
    pov: tuple[list[str], str, int | None] | None = None
    max_tokens: int | None = None
    state_chats: list[str] | None = None


def scoped(tables, chats: list[str]):
    """The tables for requests about these chats: the chats' events and memory, which most parts of a retrieval start from, are derived once and kept."""
    return tables.keeping(**{name: stored(search._scoped(tables(name), chats)) for name in ("story_events", "memory")})


def retrieve(tables, r: Request, settings: dict | None = None) -> dict[str, DataFrame]:
    """Frames by name.  The search runs here; the rest is lazy, until a frame or the block made of them is asked for."""
    budgets = search.resolve_budgets(settings, r.profile, r.overrides)
    mentioned = search.mentioned(tables("characters"), tables("participated"), tables("story_events"), r.chats, r.query)
    # at most the budgets' few dozen rows, which most of what follows starts from
    hits = durable(search.hybrid(tables, r.chats, r.vector, r.query, 40, mentioned, budgets))
    out = {
        "mentioned": mentioned,
        "hits": hits,
        "world_state": reads.world_state(tables("world_state"), r.state_chats if r.state_chats is not None else r.chats),
        "traits": reads.visible_traits(tables("traits"), r.ids, None, r.persona),
        "threads": reads.plot_threads(tables("plot_threads"), r.chats),
        "snapshots": reads.snapshots(tables("snapshots"), tables("locations"), r.chats),
        "events": reads.recent_events(tables("story_events"), tables("participated"), tables("characters"), r.chats),
        "relationships": reads.relationships(tables("feels"), tables("characters"), r.ids, r.chats),
        "known": reads.known_facts(tables("knows"), tables("facts"), r.names, r.chats),
        "unknown": reads.unknown_facts(tables("knows"), tables("facts"), r.names or ["-"], r.chats),
        "padding": search.neighbours(search._scoped(tables("memory"), r.chats), hits),
        "arcs": search.arc_context(tables("story_events").join(hits.where("kind = 'event'").select("id"), "id", "left_semi"), tables("arc_events"), tables("story_arcs")),
    }
    if r.pov:
        known = pov.universe(tables, *r.pov)
        out["hits"] = pov.mask_hits(hits, known)
        out["events"] = pov.mask_events(out["events"], known)
        out["padding"] = out["padding"].join(known["indices"], "message_index", "left_semi")
        out["arcs"] = out["arcs"].join(known["events"].withColumnRenamed("id", "event_id"), "event_id", "left_semi")
    out["budgets"] = budgets
    return out


def block(tables, result: dict, max_tokens: int | None = None) -> DataFrame:
    """The result's text, one row, in one job."""
    b, hits = result["budgets"], result["hits"]
    sections = [
        render.world_state(result["world_state"]),
        render.traits(result["traits"]),
        render.threads(result["threads"]),
        render.events(hits, tables("story_events").select("id", "summary", "source_text", "message_index"), b["event"]),
        render.memories(hits, tables("memory"), result["padding"], b["memory"]),
        render.dialogue(hits, tables("quotes").select("id", "speaker", "quote", "message_index"), b["dialogue"]),
        render.matched_scenes(hits, tables("snapshots").select("id", "summary", "location_id", "tone", "message_index"), tables("locations"), b["snapshot"]),
        render.scenes(result["snapshots"]),
        render.recent(result["events"]),
        render.knowledge(result["known"], result["unknown"]),
        render.relations(result["relationships"]),
    ]
    return render.block(sections, render.max_chars(max_tokens, b["chars"]))
