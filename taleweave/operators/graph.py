"""The property graph: typed edges, breadth-first expansion, global view, degrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable as shared_copy
from ..session import stored
from ..sources.fixtures import lean


def _edge(rows: DataFrame, kind: str, a, a_type: str, b, b_type: str, two_way: bool = False) -> DataFrame:
    out = rows.select(F.lit(kind).alias("edge"), F.col(a).alias("src"), F.lit(a_type).alias("src_type"), F.col(b).alias("dst"), F.lit(b_type).alias("dst_type")).where("src IS NOT NULL AND dst IS NOT NULL")
    if two_way:  # both from one row, so that what finds the rows runs once
        way = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, ("src", "src_type", "dst", "dst_type"), strict=True)])
        out = out.select("edge", F.explode(F.array(way("src", "src_type", "dst", "dst_type"), way("dst", "dst_type", "src", "src_type"))).alias("w")).select("edge", "w.*")
    return out


def edges(tables, chats: list[str] | None = None) -> DataFrame:
    """edge, src, src_type, dst, dst_type: feelings, participation and arcs both ways, the rest one way."""
    scoped = lambda rows: rows.where(F.col("chat_id").isin(chats)) if chats else rows
    events = scoped(lean(tables, "story_events"))
    in_scope = events.select(F.col("id").alias("event_id"))
    feels = tables("feels").withColumnRenamed("session_id", "chat_id")
    items = scoped(tables("items"))
    threads = scoped(tables("plot_threads")).select(F.col("id").alias("plot_id"))
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            _edge(scoped(feels), "feels_about", "from_id", "character", "to_id", "character", True),
            _edge(tables("participated").join(in_scope, "event_id", "left_semi"), "participated_in", "character_id", "character", "event_id", "event", True),
            _edge(tables("arc_events").join(in_scope, "event_id", "left_semi"), "arc_events", "arc_id", "story_arc", "event_id", "event", True),
            _edge(scoped(tables("knows")), "knows", "character_id", "character", "fact_id", "fact"),
            _edge(events, "at", "id", "event", "location_id", "location"),
            _edge(items, "owns", "owner_id", "character", "id", "item"),
            _edge(items, "lies_at", "id", "item", "location_id", "location"),
            _edge(tables("plot_characters").join(threads, "plot_id", "left_semi"), "plot", "character_id", "character", "plot_id", "plot_thread"),
            _edge(tables("chains").join(in_scope.withColumnRenamed("event_id", "from_id"), "from_id", "left_semi"), "chain", "from_id", "event", "to_id", "event"),
        ],
    )


def expand(all_edges: DataFrame, seeds: DataFrame, depth: int = 3, durable=None) -> DataFrame:
    """id, type, hop: everything within `depth` steps of the seeds (id, type), at its least number of steps.

    A frontier join for each step: only nodes that are new go on, so the edges are never joined with all
    that was seen.  durable(df) cuts the lineage after each step, without which plans would double with it; the
    edges are then found once and kept as a table, which each step reads.
    """
    keep = durable or (shared_copy if depth > 2 else lambda x: x)
    step = keep(seeds.select("id", "type", F.lit(0).alias("hop")).distinct())
    seen = step
    links = all_edges.select(F.col("src").alias("id"), F.col("src_type").alias("type"), "dst", "dst_type")
    links = stored(links) if durable or depth > 2 else links
    for hop in range(1, depth + 1):
        new = links.join(step.select("id", "type"), ["id", "type"], "left_semi").select(F.col("dst").alias("id"), F.col("dst_type").alias("type")).distinct()
        step = keep(new.join(seen.select("id", "type"), ["id", "type"], "left_anti").select("id", "type", F.lit(hop).alias("hop")))
        seen = seen.unionByName(step)
    return seen


def neighbourhood(pairs: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """id, hop over undirected pairs (a, b)."""
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    typed = both.withColumns({"src_type": F.lit("n"), "dst_type": F.lit("n")})
    return expand(typed, seeds.select("id", F.lit("n").alias("type")), depth).select("id", "hop")


def induced(all_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among the nodes (id, type)."""
    a, b = (nodes.select(F.col("id").alias(i), F.col("type").alias(t)) for i, t in (("src", "src_type"), ("dst", "dst_type")))
    return all_edges.join(a, ["src", "src_type"], "left_semi").join(b, ["dst", "dst_type"], "left_semi")


def degrees(pairs: DataFrame) -> DataFrame:
    """id, degree over pairs (from_id, to_id); counted before the shuffle."""
    return pairs.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


PREFIX = {"feels_about": "fa", "knows": "kn", "participated_in": "pi", "at": "at", "owns": "own", "plot": "pt", "arc_events": "ae", "chain": "ch"}
INTENSITY = {"knows": 0.3, "participated_in": 0.5, "at": 0.4, "owns": 0.5, "plot": 0.4, "arc_events": 0.7, "chain": 0.7}


def edge_rows(all_edges: DataFrame) -> DataFrame:
    """edge_id, edge, src, dst, intensity, one way each, as a viewer reads them."""
    names = F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])
    strength = F.create_map(*[F.lit(x) for kv in INTENSITY.items() for x in kv])
    forward = all_edges.where(F.col("edge").isin(*PREFIX)).where(~((F.col("edge") == "participated_in") & (F.col("src_type") == "event")) & ~((F.col("edge") == "arc_events") & (F.col("src_type") == "event")))
    once = forward.select("edge", "src", "dst").distinct()  # the id and the intensity follow from these
    return once.select(F.concat_ws("-", F.element_at(names, F.col("edge")), "src", "dst").alias("edge_id"), "edge", "src", "dst", F.coalesce(F.try_element_at(strength, F.col("edge")), F.lit(0.5)).alias("intensity"))


def chats_of(characters: DataFrame, participated: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """chat_id of the chats in which a character of that name or alias takes part."""
    who = characters.where((F.lower("name") == name.lower()) | (F.col("alias") == name.lower())).select(F.col("id").alias("character_id"))
    mine = participated.join(who, "character_id", "left_semi").select(F.col("event_id").alias("id"))
    return events.join(mine, "id", "left_semi").select("chat_id").distinct()


def touched(all_edges: DataFrame) -> DataFrame:
    """id, type of the nodes that some edge touches: the global view, which has no facts."""
    own = all_edges.where(F.col("edge") != "knows")
    return own.select(F.col("src").alias("id"), F.col("src_type").alias("type")).unionByName(own.select(F.col("dst").alias("id"), F.col("dst_type").alias("type"))).distinct()
