"""Identity: names to ids, duplicate audits, merging of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import naming
from .search import scope


def resolve(characters: DataFrame, names: DataFrame, chats=None, fallbacks: bool = True) -> DataFrame:
    """name, id, how, rank.  characters: id, name, alias, chat_id (optional).  names: name.

    First the ids that a name would have, then rows whose name or alias equals it (of the scope before those
    without a chat), then, for names of four letters or more without such a row, one row of which the name
    holds the other.  Equal names meet in an equi-join; only the few names that are left are compared.
    """
    chats = scope(chats)
    rows = characters if "chat_id" in characters.columns else characters.withColumn("chat_id", F.lit(None).cast("string"))
    asked = names.where(F.trim("name") != "").select("name").distinct().withColumn("form", X.norm_name("name"))
    visible = rows.where(F.col("chat_id").isin(chats) | F.col("chat_id").isNull()) if chats else rows
    forms = visible.select("id", "chat_id", F.explode(F.array_distinct(F.array(X.norm_name("name"), X.norm_name("alias")))).alias("form"))
    exact = asked.join(forms, "form").groupBy("name", "id").agg(F.min(F.when(F.col("chat_id").isNull(), 1).otherwise(0)).alias("scoped"))
    exact = exact.select("name", "id", F.lit("exact").alias("how"), (10 + F.col("scoped")).alias("rank"))
    parts = [exact]
    if fallbacks:
        ids = X.fallback_ids("name", X.strings(chats))
        parts.insert(0, asked.select("name", F.posexplode(ids).alias("rank", "id")).select("name", "id", F.lit("fallback").alias("how"), "rank"))
    if chats:
        left = asked.where(F.length("form") >= 4).join(exact.select("name"), "name", "left_anti")
        longer = rows.where(F.col("chat_id").isin(chats) & (F.length("name") >= 4)).select("id", F.col("name").alias("own"), X.norm_name("name").alias("n"))
        met = naming.containing_either(left.select(F.col("name").alias("id"), F.col("form").alias("text")), longer.select("id", F.col("n").alias("text")).distinct())
        near = met.select(F.col("l").alias("name"), F.col("r").alias("id")).join(longer, "id")
        best = F.row_number().over(Window.partitionBy("name").orderBy(F.desc(F.length("own")), "id"))
        parts.append(near.withColumn("r", best).where("r = 1").select("name", "id", F.lit("contained").alias("how"), F.lit(20).alias("rank")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("name", "id").agg(F.min(F.struct("rank", "how")).alias("m")).select("name", "id", "m.how", "m.rank")


def find(characters: DataFrame, name: str) -> DataFrame:
    """The row of a name, alias or slug: at most one."""
    form = F.lit(" ".join(name.lower().split()))
    hit = (X.norm_name("name") == form) | (X.norm_name("alias") == form) | (F.col("id") == X.slug(F.lit(name)))
    return characters.where(hit).orderBy("id").limit(1)


def duplicates(characters: DataFrame, participated: DataFrame, least: int = 2) -> DataFrame:
    """Rows of names that several rows have: name, id, size, events, keep (the one with the most events)."""
    named = characters.withColumn("form", X.norm_name("name"))
    groups = named.groupBy("form").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    rows = named.join(groups, "form")
    counts = participated.join(rows.select(F.col("id").alias("character_id")), "character_id", "left_semi").groupBy(F.col("character_id").alias("id")).agg(F.count("*").alias("events"))
    rows = rows.join(counts, "id", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    first = F.row_number().over(Window.partitionBy("form").orderBy(F.desc("events"), "id"))
    return rows.select(F.col("form").alias("name"), "id", "size", "events", (first == 1).alias("keep"))


def repoint(rows: DataFrame, column: str, ids: DataFrame, key: list[str]) -> DataFrame:
    """Rows with a merged id replaced.  ids: old, new.  key: what must be unique, with the column itself.

    A replaced row falls away where its new id has a row of that key already, or an earlier replaced one;
    null equals nothing.  Rows of other ids aren't touched.
    """
    moved = rows.join(ids, F.col(column) == F.col("old"), "left").withColumns({"_moved": F.col("new").isNotNull(), column: F.coalesce("new", column)})
    if key:
        place = F.row_number().over(Window.partitionBy(*key).orderBy("_moved", "old", *[c for c in rows.columns if c not in key]))
        full = F.lit(True)
        for c in key:
            full &= F.col(c).isNotNull()
        own = moved.join(ids.select(F.col("new").alias(column)).distinct(), column, "left_semi")
        rest = moved.join(ids.select(F.col("new").alias(column)).distinct(), column, "left_anti").select(*rows.columns)
        kept = own.withColumn("_r", place).where(~F.col("_moved") | ~full | (F.col("_r") == 1))
        return rest.unionByName(kept.select(*rows.columns))
    return moved.select(*rows.columns)


def repoint_array(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return rows.withColumn(column, F.array_distinct(F.transform(column, lambda x: F.when(x == old, F.lit(new)).otherwise(x))))


#: Where characters' ids stand: table, column, what else its key has.
POINTS = [
    ("feels", "from_id", ["to_id", "session_id"]), ("feels", "to_id", ["from_id", "session_id"]), ("knows", "character_id", ["fact_id", "chat_id"]),
    ("participated", "character_id", ["event_id"]), ("plot_characters", "character_id", ["plot_id"]), ("traits", "character_id", ["category", "normalized_content"]),
    ("present_at", "character_id", []), ("items", "owner_id", []),
]
MENTIONS = [("snapshots", "present_chars"), ("plot_threads", "involved_chars")]


def merge_characters(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables after each `old` character has become its `new` one: eight columns, two arrays, and the characters' own rows.

    ids: old, new; no `new` is an `old`.  The kept row takes the others' names and aliases, and a description if it has none.
    Tables that aren't given are left out.
    """
    out = dict(tables)
    for name, column, key in POINTS:
        if name in out:
            out[name] = repoint(out[name], column, ids, [column, *key] if key else [])
    for name, column in MENTIONS:
        if name in out and column in out[name].columns:
            rows = out[name].withColumn("_n", F.monotonically_increasing_id())
            named = rows.select("_n", F.explode(column).alias("old")).join(ids, "old", "left").groupBy("_n").agg(F.array_sort(F.collect_set(F.coalesce("new", "old"))).alias("_to"), F.max(F.col("new").isNotNull()).alias("_hit"))
            out[name] = rows.join(named, "_n", "left").withColumn(column, F.when(F.col("_hit"), F.col("_to")).otherwise(F.col(column))).select(*out[name].columns)
    if "characters" in out:
        people = out["characters"]
        gone = people.join(ids, people["id"] == ids["old"])
        filled = lambda a: F.filter(F.flatten(a), lambda x: F.trim(x) != "")
        taken = gone.groupBy(F.col("new").alias("id")).agg(filled(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", X.strings([]))))).alias("_names"), F.min_by(F.nullif("description", F.lit("")), F.when(F.nullif("description", F.lit("")).isNotNull(), F.col("old"))).alias("_told"))
        rest = people.join(ids.select(F.col("old").alias("id")), "id", "left_anti").join(taken, "id", "left")
        both = F.array_sort(F.array_distinct(filled(F.array(F.coalesce("aliases", X.strings([])), F.col("_names")))))
        rest = rest.withColumns({"aliases": F.when(F.col("_names").isNotNull(), both).otherwise(F.col("aliases")), "description": F.when(F.col("_names").isNotNull(), F.coalesce(F.nullif("description", F.lit("")), "_told")).otherwise(F.col("description"))})
        out["characters"] = rest.select(*people.columns)
    return out


def upsert(characters: DataFrame, batch: DataFrame) -> DataFrame:
    """The characters (id, chat_id, name, aliases, description, ...) after a batch of chat_id, name, aliases, description.

    An incoming character is the row of its chat, or of none if it has none, whose name, or else alias, is one of its
    forms; then the one with more aliases, the longer name, the smaller id.  That row keeps its name and takes the forms,
    but for names of other rows; an empty description changes nothing.  Without such a row there is a new one.  Incoming
    rows of one chat and name are one; those that name each other otherwise come in batches of their own.
    """
    bare = lambda c: F.lower(F.trim(c))
    given = F.array_distinct(F.filter(F.transform(F.concat(F.array("name"), F.coalesce("aliases", X.strings([]))), lambda x: F.trim(x)), lambda x: x != ""))
    asked = batch.where("trim(name) <> ''").select("chat_id", F.trim("name").alias("name"), given.alias("forms"), F.nullif("description", F.lit("")).alias("told"))
    asked = asked.groupBy("chat_id", "name").agg(F.array_distinct(F.flatten(F.collect_list("forms"))).alias("forms"), F.max("told").alias("told")).withColumn("scope", F.coalesce("chat_id", F.lit("")))
    own = F.coalesce("aliases", X.strings([]))
    known = characters.select("id", F.coalesce("chat_id", F.lit("")).alias("scope"), bare("name").alias("n"), F.size(own).alias("many"), F.length("name").alias("long"), F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), own), lambda x: bare(x)))).alias("form"))
    forms = asked.select("scope", F.col("name").alias("asked"), F.explode("forms").alias("said")).withColumn("form", bare("said"))
    hits = forms.join(known, ["scope", "form"]).groupBy("scope", "asked").agg(F.min(F.struct((F.col("n") != F.col("form")).alias("a"), (-F.col("many")).alias("b"), (-F.col("long")).alias("c"), "id")).alias("m")).select("scope", "asked", "m.id")
    named = characters.select(bare("name").alias("form"), F.col("id").alias("other")).distinct()
    mine = forms.join(hits, ["scope", "asked"])
    clean = mine.join(named, (mine["form"] == named["form"]) & (mine["id"] != named["other"]), "left_anti").groupBy("id").agg(F.collect_set("said").alias("_forms"))
    told = hits.join(asked.select("scope", F.col("name").alias("asked"), "told"), ["scope", "asked"]).groupBy("id").agg(F.max("told").alias("_told"))
    old = characters.join(told, "id", "left").join(clean, "id", "left")
    both = F.array_sort(F.array_distinct(F.filter(F.concat(own, F.col("_forms")), lambda x: F.trim(x) != "")))
    old = old.withColumns({"aliases": F.when(F.col("_forms").isNotNull(), both).otherwise(F.col("aliases")), "description": F.coalesce("_told", "description")}).select(*characters.columns)
    fresh = asked.join(hits.select("scope", F.col("asked").alias("name")), ["scope", "name"], "left_anti").select(X.chat_scoped_id("name", "chat_id").alias("id"), "chat_id", "name", F.array_sort("forms").alias("aliases"), F.coalesce("told", F.lit("")).alias("description"))
    return old.unionByName(fresh, allowMissingColumns=True)
