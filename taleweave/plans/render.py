"""A retrieval's result as one text: ordered sections of ordered lines, joined on the cluster and cut to size.

Every section is a frame (section, place, line) of few rows.  Their union is one job, whose last step
joins the lines of the sections that have any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Sections in their order, and how much of each is shown.
SECTIONS = (
    "World State", "Persona Traits", "Character Traits", "Active Plot Threads", "Matched Event Passages", "Relevant Past Context", "Matched Dialogue Quotes",
    "Matched Scene Snapshots", "Scene Context", "Recent Events", "Character Knowledge Boundaries", "Relationships",
)
LIMITS = {"memory": 1800, "neighbour": 700, "event": 2000, "quote": 600, "snapshot": 1200, "source": 200, "knows": 5, "not_known": 3, "relations": 10, "description": 150, "traits": 8}
SHOWN = {"memory": 3, "event": 4, "dialogue": 4, "snapshot": 3}
OPEN, CLOSE, CUT = "[Story Memory]", "[/Story Memory]", "[...truncated]"


def _lines(rows: DataFrame, section: str, order: list, line: Column) -> DataFrame:
    place = F.row_number().over(Window.orderBy(*order))  # of a section's few rows
    return rows.select(F.lit(SECTIONS.index(section)).alias("section"), place.alias("place"), line.alias("line")).where("line IS NOT NULL")


def _turn(c="message_index") -> Column:
    return F.when(F.col(c).isNotNull(), F.concat(F.lit("[turn "), F.col(c), F.lit("] "))).otherwise("")


def _flat(c) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))


def world_state(rows: DataFrame) -> DataFrame:
    return _lines(rows, "World State", [F.desc("valid_from"), F.desc("id")], F.concat(F.lit("- "), "key", F.lit(": "), "value"))


def traits(rows: DataFrame) -> DataFrame:
    """rows: pool, character_id, category, content, merged_count, id."""
    r = F.row_number().over(Window.partitionBy("pool", "character_id", "category").orderBy(F.col("merged_count").desc_nulls_last(), "id"))
    few = rows.withColumn("r", r).where(F.col("r") <= LIMITS["traits"])
    lines = few.groupBy("pool", "character_id", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "content"))), lambda x: x["content"]), ", ").alias("t"))
    line = F.concat(F.lit("- "), "category", F.lit(": "), "t")
    heads = lines.select("pool", "character_id").distinct().select("pool", "character_id", F.lit("").alias("category"), F.concat("character_id", F.when(F.col("pool") == "persona", " (persona):").otherwise(":")).alias("line"))
    both = heads.unionByName(lines.select("pool", "character_id", "category", line.alias("line")))
    own = lambda pool, name: _lines(both.where(F.col("pool") == pool), name, ["character_id", "category"], F.col("line"))
    return own("persona", "Persona Traits").unionByName(own("chat", "Character Traits"))


def threads(rows: DataFrame) -> DataFrame:
    return _lines(rows, "Active Plot Threads", [F.desc("importance"), "id"], F.concat(F.lit("- ["), "status", F.lit("] "), "title"))


def events(hits: DataFrame, story: DataFrame, cap: int) -> DataFrame:
    rows = hits.where("kind = 'event'").select("id", "score").join(story, "id")
    summary, raw = F.substring(_flat("summary"), 1, LIMITS["event"]), X.strip_blocks("source_text")
    quote = F.when(raw != "", F.concat(F.lit('\n  > "'), F.substring(raw, 1, LIMITS["source"]), F.lit('"'))).otherwise("")
    line = F.concat(F.lit("- "), _turn(), F.when(summary != "", F.concat(summary, quote)).otherwise(F.substring(raw, 1, LIMITS["event"])))
    return _lines(rows, "Matched Event Passages", [F.desc("score"), "id"], line).where(F.col("place") <= cap)


def memories(hits: DataFrame, memory: DataFrame, padding: DataFrame, cap: int) -> DataFrame:
    """The best hit of each turn, with the turns before and after it."""
    rows = hits.where("kind = 'memory'").select("id", "score").join(memory.select(F.col("id").cast("string").alias("id"), "chat_id", "message_index", X.strip_blocks("raw_text").alias("text")), "id").where("text <> ''")
    first = F.row_number().over(Window.partitionBy("chat_id", F.coalesce(F.col("message_index").cast("string"), F.col("id"))).orderBy(F.desc("score"), "id"))
    rows = rows.withColumn("r", first).where("r = 1").withColumn("p", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).where(F.col("p") <= cap)
    own = rows.select("p", F.lit(0).alias("q"), F.concat(F.lit("- "), _turn(), F.substring("text", 1, LIMITS["memory"])).alias("line"))
    near = padding.select("chat_id", F.col("message_index").alias("n"), X.strip_blocks("raw_text").alias("t")).where("t <> ''")
    parts = [own]
    for q, (name, step) in enumerate((("PREV", -1), ("NEXT", 1)), 1):
        j = rows.withColumn("n", F.col("message_index") + step).join(near, ["chat_id", "n"])
        parts.append(j.select("p", F.lit(q).alias("q"), F.concat(F.lit(f"- [{name} TURN "), "n", F.lit(" — context for turn "), "message_index", F.lit("] "), F.substring("t", 1, LIMITS["neighbour"])).alias("line")))
    return _lines(reduce(lambda a, b: a.unionByName(b), parts), "Relevant Past Context", ["p", "q"], F.col("line"))


def dialogue(hits: DataFrame, quotes: DataFrame, cap: int) -> DataFrame:
    rows = hits.where("kind = 'dialogue'").select("id", "score").join(quotes, "id")
    line = F.concat(F.lit("- "), _turn(), "speaker", F.lit(': "'), F.substring("quote", 1, LIMITS["quote"]), F.lit('"'))
    return _lines(rows, "Matched Dialogue Quotes", [F.desc("score"), "id"], line).where(F.col("place") <= cap)


def _scene(summary: Column) -> Column:
    at = F.when(F.col("location_name").isNotNull(), F.concat(F.lit(" [at "), "location_name", F.lit("]"))).otherwise("")
    tone = F.when(F.coalesce("tone", F.lit("")) != "", F.concat(F.lit(" ("), "tone", F.lit(")"))).otherwise("")
    return F.concat(summary, at, tone)


def matched_scenes(hits: DataFrame, snapshots: DataFrame, locations: DataFrame, cap: int) -> DataFrame:
    rows = hits.where("kind = 'snapshot'").select("id", "score").join(snapshots, "id").join(locations.select(F.col("id").alias("location_id"), F.col("name").alias("location_name")), "location_id", "left")
    return _lines(rows, "Matched Scene Snapshots", [F.desc("score"), "id"], F.concat(F.lit("- "), _turn(), _scene(F.substring("summary", 1, LIMITS["snapshot"])))).where(F.col("place") <= cap)


def scenes(rows: DataFrame) -> DataFrame:
    return _lines(rows, "Scene Context", [F.desc("message_index"), "id"], F.concat(F.lit("- "), _scene(F.col("summary"))))


def recent(rows: DataFrame) -> DataFrame:
    order = [F.col("world_time").isNull(), "world_time", "message_index", "id"]
    number = F.row_number().over(Window.orderBy(*order))
    who = F.when(F.size("participants") > 0, F.concat(F.lit(" ("), F.array_join("participants", ", "), F.lit(")"))).otherwise("")
    quote = F.when(F.trim(F.coalesce("source_text", F.lit(""))) != "", F.concat(F.lit('\n   > "'), F.trim(F.substring(F.regexp_replace("source_text", r"\s+", " "), 1, LIMITS["source"])), F.lit('"'))).otherwise("")
    numbered = rows.withColumn("n", number)
    return _lines(numbered, "Recent Events", ["n"], F.concat("n", F.lit(". [sig "), F.coalesce(F.col("significance").cast("string"), F.lit("?")), F.lit("/5] "), "summary", who, quote))


def knowledge(known: DataFrame, unknown: DataFrame) -> DataFrame:
    def part(rows: DataFrame, verb: str, place: int, take: int) -> DataFrame:
        r = F.row_number().over(Window.partitionBy("character_id").orderBy("fact_id"))
        few = rows.withColumn("r", r).where(F.col("r") <= take).groupBy("character_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "content"))), lambda x: x["content"]), "; ").alias("t"))
        return few.select("character_id", F.lit(place).alias("o"), F.concat(F.lit("- "), "character_id", F.lit(f" {verb}: "), "t").alias("line"))

    both = part(known, "knows", 0, LIMITS["knows"]).unionByName(part(unknown, "does NOT know", 1, LIMITS["not_known"]))
    return _lines(both, "Character Knowledge Boundaries", ["character_id", "o"], F.col("line"))


def relations(rows: DataFrame) -> DataFrame:
    percent = F.round(F.coalesce("intensity", F.lit(0.0)) * 100).cast("int")
    line = F.concat(F.lit("- "), "from_name", F.lit(" → "), "to_name", F.lit(": "), X.sentiment_label("sentiment"), F.lit(" ("), percent, F.lit("%)"))
    return _lines(rows, "Relationships", [F.desc("intensity"), "from_id", "to_id"], line).where(F.col("place") <= LIMITS["relations"])


def block(sections: list[DataFrame], limit: int) -> DataFrame:
    """One row, text: the sections that have lines, between the marks, cut so that the closing mark stays."""
    rows = reduce(lambda a, b: a.unionByName(b), sections)
    names = F.array(*[F.lit(s) for s in SECTIONS])
    told = rows.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body"))
    told = told.select("section", F.concat(F.lit("## "), F.get(names, F.col("section")), F.lit("\n"), "body").alias("body"))
    whole = told.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda x: x["body"]), "\n\n").alias("body"))
    close = "\n\n" + CLOSE
    text = F.concat(F.lit(OPEN + "\n\n"), "body", F.lit(close))
    room = max(0, limit - len(close) - len(CUT) - 1)
    return whole.select(F.when(F.length(text) > limit, F.concat(F.substring(text, 1, room), F.lit("\n" + CUT + close))).otherwise(text).alias("text"))


def max_chars(tokens: int | None = None, profile_chars: int | None = None) -> int:
    """Four characters for each token; explicit before the profile's, 1500 tokens if neither is given."""
    return tokens * 4 if tokens else profile_chars or 1500 * 4
