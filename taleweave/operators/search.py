"""Search: six ranked sources, fusion by reciprocal rank, boosts, caps, and what surrounds a hit.

Every source is a filter on chat scope, a score column and a top-k, so Spark plans each as a scan with
pushed-down scope and a TakeOrderedAndProject: no shuffle of the scanned table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import english
from ..functions import relevance as R
from ..functions import text as X
from ..functions import vector as V
from . import postings

# Caps by kind, and how many rows a source fetches for a limit.
DEFAULT_CAPS = {"memory": 24, "event": 10, "dialogue": 10, "snapshot": 8}
BUDGETS = {
    "inject": {"memory": 12, "event": 8, "dialogue": 10, "snapshot": 3, "chars": 3000},
    "panel": {"memory": 5, "event": 0, "dialogue": 5, "snapshot": 0, "chars": 1500},
    "mindmap": {"memory": 30, "event": 0, "dialogue": 0, "snapshot": 0, "chars": 8000},
}
SOURCES = ("memory_vector", "memory_text", "event_text", "event_vector", "dialogue", "snapshot", "boost")
BOOST_ROWS = 30


def scope(chats) -> list[str]:
    """A name, a list of names or nothing, as a list without blanks."""
    return [chats] if isinstance(chats, str) and chats else [c for c in chats or [] if isinstance(c, str) and c]


def resolve_budgets(settings: dict | None = None, profile: str = "inject", overrides: dict | None = None) -> dict:
    """Overrides win over settings, these over the profile; an unknown profile is `inject`."""
    name = profile if profile in BUDGETS else "inject"
    own = ((settings or {}).get("budgets") or {}).get(name) or {}
    return {k: next((x[k] for x in (overrides or {}, own) if x.get(k) is not None), v) for k, v in BUDGETS[name].items()}


def terms_of(query: str) -> list[str]:
    """The query's terms, in order; none means that text sources find nothing."""
    cleaned = "".join(c if c.isascii() and (c.isalnum() or c.isspace()) else " " for c in (query or "").lower())
    return list(dict.fromkeys(w for w in cleaned.split() if len(w) > 2 and w not in X.QUERY_STOP_WORDS))


def _scoped(rows: DataFrame, chats) -> DataFrame:
    names = scope(chats)
    return rows.where(F.col("chat_id").isin(names)) if names else rows.where(F.lit(False))


def nearest(rows: DataFrame, vector: list[float], limit: int) -> DataFrame:
    scored = rows.where(F.col("embedding").isNotNull()).withColumn("similarity", F.round(V.cosine_to(F.col("embedding"), vector), 9)).drop("embedding")
    return scored.orderBy(F.desc("similarity"), "id").limit(limit)


def ranked_text(rows: DataFrame, text: str, query: str, limit: int) -> DataFrame:
    """The best rows by the English OR rank, in one pass over the texts of the rows; `postings.ranked` reads an index instead."""
    terms = english.query_lexemes(terms_of(query))
    if not terms:
        return rows.where(F.lit(False)).withColumn("rank", F.lit(0.0))
    found = rows.withColumn("_n", english.times_of(text, terms)).where(F.exists("_n", lambda n: n > 0))
    return found.withColumn("rank", F.round(postings.or_rank(F.col("_n")), 9)).drop("_n").orderBy(F.desc("rank"), "id").limit(limit)


def vector_memory(memory: DataFrame, chats, vector, limit: int = 5) -> DataFrame:
    return nearest(_scoped(memory, chats).select("id", "chat_id", "node_type", "node_id", "content", F.coalesce("raw_text", "content").alias("raw_text"), "message_index", "embedding"), vector, limit)


def text_memory(memory: DataFrame, chats, query: str, limit: int = 5) -> DataFrame:
    return ranked_text(_scoped(memory, chats).select("id", "chat_id", "node_type", "node_id", "content", F.coalesce("raw_text", "content").alias("raw_text"), "message_index"), "content", query, limit)


def vector_events(events: DataFrame, chats, vector, limit: int = 5) -> DataFrame:
    return nearest(_scoped(events, chats).select("id", "chat_id", "summary", "significance", "message_index", "embedding"), vector, limit)


def text_events(events: DataFrame, chats, query: str, limit: int = 5) -> DataFrame:
    return ranked_text(_scoped(events, chats).select("id", "chat_id", "summary", "source_text", "significance", "message_index"), "source_text", query, limit)


def vector_snapshots(snapshots: DataFrame, locations: DataFrame, chats, vector, limit: int = 5) -> DataFrame:
    """The place is looked up for the rows that are left, not before."""
    top = nearest(_scoped(snapshots, chats).select("id", "chat_id", "summary", "location_id", "message_index", "embedding"), vector, limit)
    return top.join(locations.select(F.col("id").alias("location_id"), F.col("name").alias("location_name")), "location_id", "left").orderBy(F.desc("similarity"), "id")


def dialogue(quotes: DataFrame, chats, query: str, limit: int = 5) -> DataFrame:
    """Text rank and trigram similarity, twice the limit each, fused; nothing without query terms."""
    rows = _scoped(quotes, chats).select("id", "chat_id", "speaker", "quote", "message_index")
    by_text = ranked_text(rows, "quote", query, 2 * limit)
    if not terms_of(query):
        return by_text.withColumnRenamed("rank", "score")
    like = rows.withColumn("rank", F.round(R.trigram_similarity("quote", F.lit(query)), 9)).where(F.col("rank") >= R.TRIGRAM_MATCH).orderBy(F.desc("rank"), "id").limit(2 * limit)
    order = Window.orderBy(F.desc("rank"), "id")  # of at most 2 * limit rows
    both = by_text.withColumn("r", F.row_number().over(order)).unionByName(like.withColumn("r", F.row_number().over(order)))
    fused = both.groupBy("id", "chat_id", "speaker", "quote", "message_index").agg(F.round(F.sum(R.reciprocal(F.col("r"))), 12).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(limit)


def top_index(tables: list[DataFrame]) -> DataFrame:
    """One row: the greatest message_index of the tables, 0 if there is none."""
    rows = reduce(lambda a, b: a.unionByName(b), (t.select("message_index") for t in tables))
    return rows.agg(F.coalesce(F.max("message_index"), F.lit(0)).alias("top"))


def mentioned(characters: DataFrame, participated: DataFrame, events: DataFrame, chats, query: str) -> DataFrame:
    """id, name of characters with an event in scope whose name or alias, of 3 letters or more, is in the query."""
    forms = characters.select("id", "name", F.explode(F.array("name", "alias")).alias("form")).where(F.length("form") >= 3)
    said = forms.where(F.contains(F.lower(F.lit(query)), F.lower("form"))).select("id", "name").distinct()
    # the few named ones first: what they took part in is then told apart, not what all did
    took = participated.join(said.select(F.col("id").alias("character_id")), "character_id", "left_semi")
    active = took.join(_scoped(events, chats).select(F.col("id").alias("event_id")), "event_id", "left_semi").select(F.col("character_id").alias("id"))
    return said.join(active, "id", "left_semi")


def boosted(events: DataFrame, participated: DataFrame, chats, ids: DataFrame, limit: int = BOOST_ROWS) -> DataFrame:
    """Events of the given characters, the most significant and latest first."""
    mine = participated.join(ids.select(F.col("id").alias("character_id")), "character_id", "left_semi").select(F.col("event_id").alias("id"))
    return _scoped(events, chats).join(mine, "id", "left_semi").select("id", "chat_id", "summary", "significance", "message_index").orderBy(F.col("significance").desc_nulls_last(), F.col("message_index").desc_nulls_last(), "id").limit(limit)


def cap_kinds(hits: DataFrame, caps: dict[str, int], limit: int, ties: list[str]) -> DataFrame:
    """The first of each kind up to its cap, then the first of all; kinds without a cap go."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), *ties))
    return hits.withColumn("_r", place).where(F.col("_r") <= F.coalesce(F.try_element_at(cap, F.col("kind")), F.lit(0))).drop("_r").orderBy(F.desc("score"), *ties).limit(limit)


def fuse(sources: dict[str, tuple[str, DataFrame, list]], top: DataFrame | None = None) -> DataFrame:
    """kind, id, chat_id, message_index, source, score of all hits.

    sources: name -> (kind, rows, order).  A hit's score is the sum of 1/(60+rank) over the sources that
    found it, plus a little for being recent; its payload is that of the first source in SOURCES order.
    """
    parts = []
    for i, name in enumerate(SOURCES):
        if name not in sources:
            continue
        kind, rows, order = sources[name]
        rank = F.row_number().over(Window.orderBy(*order))  # of a source's few rows
        parts.append(rows.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "chat_id", "message_index", F.lit(i).alias("place"), rank.alias("rank")))
    hits = reduce(lambda a, b: a.unionByName(b), parts)
    out = hits.groupBy("kind", "id").agg(F.sum(R.reciprocal(F.col("rank"))).alias("score"), F.min(F.struct("place", "rank", "chat_id", "message_index")).alias("first"))
    if top is not None:
        out = out.crossJoin(F.broadcast(top.limit(1)))
        recent = F.when((F.col("top") > 0) & F.col("first.message_index").isNotNull(), R.RECENCY * F.col("first.message_index") / F.col("top")).otherwise(0.0)
        out = out.withColumn("score", F.col("score") + recent)
    names = F.array(*[F.lit(n) for n in SOURCES])
    return out.select("kind", "id", "first.chat_id", "first.message_index", F.get(names, F.col("first.place")).alias("source"), F.round("score", 9).alias("score"), F.col("first.place").alias("place"), F.col("first.rank").alias("rank"))


def hybrid(tables, chats, vector, query: str, limit: int = 20, boost_ids: DataFrame | None = None, budgets: dict | None = None) -> DataFrame:
    """Fused hits, best first.  tables(name): memory, event_vectors, story_events, quotes, snapshots, locations, participated.

    Without a vector only the memory's text source is used.
    """
    many = max(limit, 8) * 3
    by = lambda c: [F.desc(c), "id"]
    if vector is None:
        only = fuse({"memory_text": ("memory", text_memory(tables("memory"), chats, query, many), by("rank"))})
        return cap_kinds(only, {"memory": (budgets or DEFAULT_CAPS)["memory"]}, limit, ["place", "rank", "id"])
    sources = {
        "memory_vector": ("memory", vector_memory(tables("memory"), chats, vector, many), by("similarity")),
        "memory_text": ("memory", text_memory(tables("memory"), chats, query, many), by("rank")),
        "event_text": ("event", text_events(tables("story_events"), chats, query, min(30, 2 * limit)), by("rank")),
        "event_vector": ("event", vector_events(tables("event_vectors"), chats, vector, many), by("similarity")),
        "dialogue": ("dialogue", dialogue(tables("quotes"), chats, query, limit), by("score")),
        "snapshot": ("snapshot", vector_snapshots(tables("snapshots"), tables("locations"), chats, vector, many), by("similarity")),
    }
    if boost_ids is not None:
        sources["boost"] = ("event", boosted(tables("story_events"), tables("participated"), chats, boost_ids), [F.desc("significance"), F.desc("message_index"), "id"])
    caps = {k: budgets[k] for k in DEFAULT_CAPS} if budgets else DEFAULT_CAPS
    top = top_index([_scoped(tables("memory"), chats), _scoped(tables("story_events"), chats)])
    return cap_kinds(fuse(sources, top), caps, max(limit, sum(caps.values())) if budgets else limit, ["place", "rank", "id"])


def neighbours(memory: DataFrame, hits: DataFrame) -> DataFrame:
    """The messages one before and one after the hits that aren't hits themselves, one row for each index."""
    at = hits.where(F.col("message_index").isNotNull()).select("chat_id", "message_index").distinct()
    wanted = at.select("chat_id", F.explode(F.array(F.col("message_index") - 1, F.col("message_index") + 1)).alias("message_index")).where("message_index >= 0").distinct()
    wanted = wanted.join(at, ["chat_id", "message_index"], "left_anti")
    rows = memory.where(F.col("node_type").isin("message", "message_chunk")).join(wanted, ["chat_id", "message_index"], "left_semi")
    first = F.row_number().over(Window.partitionBy("chat_id", "message_index").orderBy("node_type", "id"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r")


def arc_context(events: DataFrame, arc_events: DataFrame, arcs: DataFrame) -> DataFrame:
    """event_id, arc_id, parent_arc_id, before, after: of each event's most important arc of level 1."""
    order = Window.partitionBy("arc_id").orderBy("position")
    mine = arc_events.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi").select("arc_id").distinct()
    around = arc_events.join(mine, "arc_id", "left_semi").withColumns({"before": F.lag("event_id").over(order), "after": F.lead("event_id").over(order)})
    level = arcs.where("hierarchy_level = 1").select(F.col("id").alias("arc_id"), "importance", "parent_arc_id")
    rows = around.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi").join(level, "arc_id")
    best = F.row_number().over(Window.partitionBy("event_id").orderBy(F.col("importance").desc_nulls_last(), "arc_id"))
    return rows.withColumn("_r", best).where("_r = 1").select("event_id", "arc_id", "parent_arc_id", "before", "after")
