"""State: versioned values, expiry, and keyed merges.  A merge takes a table and a batch and gives the new table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import relevance as R
from ..functions import text as X
from ..session import durable
from . import similarity

TTL_MESSAGES, FACT_SIMILARITY = 12, 0.45


def versions(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each change with valid_until, the time of the key's next change.  Equal values are versions too."""
    return changes.withColumn("valid_until", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy(*order)))


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state (chat_id, key, value, valid_from, valid_until, source_message_index) after a batch of changes.

    Keys are made canonical.  Only current rows of changed keys are closed, so history isn't sorted again.
    """
    new = changes.withColumn("key", X.state_key("key"))
    new = versions(new, ["chat_id", "key"], ["valid_from", "source_message_index", *(["ord"] if "ord" in changes.columns else [])])
    first = new.groupBy("chat_id", "key").agg(F.min("valid_from").alias("_at"))
    closed = state.join(first, ["chat_id", "key"], "left").withColumn("valid_until", F.coalesce("valid_until", "_at")).drop("_at")
    return closed.select(*state.columns).unionByName(new.select(*state.columns))


def close(state: DataFrame, which: Column, at: Column) -> DataFrame:
    """Current rows that a condition picks are closed."""
    return state.withColumn("valid_until", F.when(F.col("valid_until").isNull() & which, at).otherwise(F.col("valid_until")))


def supersede(state: DataFrame, chat: str, keys: list[str], at: Column) -> DataFrame:
    wanted = F.transform(X.strings(keys), lambda k: X.state_key(k))
    return close(state, (F.col("chat_id") == chat) & F.array_contains(wanted, F.col("key")), at)


def expire(state: DataFrame, current: Column, at: Column, ttl: int = TTL_MESSAGES) -> DataFrame:
    """Current rows of moment-like keys that are older than `ttl` messages are closed."""
    return close(state, X.is_snapshot_key("key") & (current - F.col("source_message_index") > ttl), at)


def clean(state: DataFrame, now: Column) -> DataFrame:
    """One-off repair: moment-like rows older than a day closed, and of each canonical key only the newest open."""
    old = X.is_snapshot_key("key") & (F.col("valid_from") < now - F.expr("INTERVAL 24 HOURS"))
    rows = close(state, old, now).withColumn("_k", X.state_key("key"))
    r = F.row_number().over(Window.partitionBy("chat_id", "_k").orderBy(F.desc("valid_from"), F.desc("id")))
    rows = rows.withColumn("_r", F.when(F.col("valid_until").isNull(), r))
    return close(rows, F.col("_r") > 1, now).drop("_k", "_r")


def merge(table: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Keyed upsert.  rules: column -> f(old, new); any other column takes the new value.  A rule in `ARRIVES` also says what a new row's value becomes.

    batch has one row for each key (see `latest`).  One full join on the key, which a table bucketed by it
    takes without a shuffle.
    """
    rules = rules or {}
    old, new = table.select(F.struct(*table.columns).alias("o"), *keys), batch.select(F.struct(*batch.columns).alias("n"), *keys)
    both = old.join(new, keys, "full")
    pick = {}
    for c in table.columns:
        if c in keys:
            pick[c] = F.col(c)
        elif c not in batch.columns:
            pick[c] = F.col(f"o.{c}")
        else:
            o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
            arrives = ARRIVES.get(rules.get(c), lambda x: x)
            pick[c] = F.when(F.col("n").isNull(), o).when(F.col("o").isNull(), arrives(n)).otherwise(rules[c](o, n) if c in rules else n)
    return both.select(*[pick[c].alias(c) for c in table.columns])


def latest(batch: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return batch.withColumn("_r", r).where("_r = 1").drop("_r")


def insert_new(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a key that isn't there yet are appended."""
    return table.unionByName(batch.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def replace(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(batch.select(*keys), keys, "left_anti").select(*table.columns).unionByName(batch.dropDuplicates(keys).select(*table.columns))


#: White space around a text, as JavaScript's trim sees it.
BLANKS = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# what a column does when a row comes again
keep_filled = lambda o, n: F.coalesce(F.nullif(n, F.lit("")), o)
trimmed = lambda n: F.nullif(F.regexp_replace(n, f"^[{BLANKS}]+|[{BLANKS}]+$", ""), F.lit(""))
keep_trimmed = lambda o, n: F.coalesce(trimmed(n), o)
greatest = lambda o, n: F.greatest(o, n)
first = lambda o, n: F.coalesce(o, n)
union = lambda o, n: F.array_distinct(F.filter(F.concat(F.coalesce(o, n), F.coalesce(n, o)), lambda x: F.trim(x) != ""))
stays = lambda o, n: o

#: Rules that change the value of a new row as well.
ARRIVES = {keep_trimmed: trimmed}



def _order() -> Column:
    return F.struct("message_index", "ord")


def _filled(c: str) -> Column:
    return F.coalesce(F.max_by(c, F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), _order())), F.min_by(c, _order()))


def _all_of(c: str) -> Column:
    lists = F.array_sort(F.collect_list(F.struct("message_index", "ord", F.col(c).alias("x"))))
    return F.array_distinct(F.filter(F.flatten(F.transform(lists, lambda r: r["x"])), lambda x: F.trim(x) != ""))


#: What each rule comes to over the rows of a batch, in the order of message_index and ord: the same as one merge after the other.
FOLDS = {
    keep_filled: _filled, keep_trimmed: lambda c: F.max_by(trimmed(F.col(c)), F.when(trimmed(F.col(c)).isNotNull(), _order())), union: _all_of, greatest: F.max, stays: lambda c: F.min_by(c, _order()), first: lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), _order())),
}


def fold(rows: DataFrame, keys: list[str], columns: list[str], rules: dict | None = None) -> DataFrame:
    """One row for each key: what merging its rows one by one would leave.  rows have message_index and ord; columns without a rule keep the last value."""
    rules = rules or {}
    out = [FOLDS[rules[c]](c).alias(c) if c in rules else F.max_by(c, _order()).alias(c) for c in columns if c not in keys]
    return rows.groupBy(*keys).agg(*out).select(*columns)


CHARACTER_RULES = {"aliases": union, "description": keep_filled, "role": keep_filled, "status": keep_filled, "significance": greatest}
#: An event that comes again brings a new summary and significance; where and when it stands stays.
EVENT_RULES = {"source_text": keep_filled, "world_time": keep_trimmed, "message_index": stays, "location_id": stays, "chat_id": stays, "ts": stays, "timestamp": stays}
ITEM_RULES = {"name": stays, "chat_id": first}
LOCATION_RULES = {"description": keep_filled, "importance": greatest}
PLOT_RULES = {"resolved_at": first}


def adjacency(moves: DataFrame) -> DataFrame:
    """chat_id, a, b: undirected pairs of places, no loops, each once.  moves: chat_id, from_id, to_id."""
    return moves.where("from_id <> to_id").select("chat_id", F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()


def presence(history: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Arrivals are current; the same characters' earlier rows in the chat no longer are."""
    moved = arrivals.select("character_id", "chat_id").distinct().withColumn("_m", F.lit(True))
    old = history.join(moved, ["character_id", "chat_id"], "left").withColumn("is_current", F.col("is_current") & F.col("_m").isNull())
    return old.select(*history.columns).unionByName(arrivals.withColumn("is_current", F.lit(True)).select(*history.columns))


def arrivals(history: DataFrame, batch: DataFrame) -> DataFrame:
    """The history (character_id, chat_id, message_index, ...) with a batch's arrivals; of each character in a chat the latest message's is current.

    A message says once where a character is; what is there already stays, so that a batch that comes again changes nothing.
    """
    keys = ["character_id", "chat_id"]
    both = insert_new(history, batch.withColumn("is_current", F.lit(False)), [*keys, "message_index"])
    top = both.join(batch.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.max("message_index").alias("_top"))
    now = F.when(F.col("_top").isNull(), F.col("is_current")).otherwise(F.col("message_index") == F.col("_top"))
    return both.join(top, keys, "left").withColumn("is_current", now).select(*history.columns)


def closings(state: DataFrame, before: DataFrame, over: DataFrame, moments: DataFrame, ttl: int = TTL_MESSAGES) -> DataFrame:
    """The state after a batch's messages have superseded and expired rows, each at the first message that does so.

    before: the state before the batch (its closed rows stay); over: chat_id, key, message_index, at of superseded keys;
    moments: chat_id, message_index, at of the batch's messages.
    """
    said = lambda rows, *by: rows.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("message_index", "at"))).alias("_m"))
    gone = said(over, "chat_id", "key").withColumnRenamed("_m", "_over")
    seen = said(moments, "chat_id").withColumnRenamed("_m", "_seen")
    done = before.where("valid_until IS NOT NULL").select("id", F.lit(True).alias("_done"))
    rows = state.join(gone, ["chat_id", "key"], "left").join(seen, "chat_id", "left").join(done, "id", "left")
    own = F.col("source_message_index")
    superseded = F.get(F.filter("_over", lambda m: m["message_index"] >= own), F.lit(0))["at"]
    expired = F.when(X.is_snapshot_key("key"), F.get(F.filter("_seen", lambda m: m["message_index"] - own > ttl), F.lit(0))["at"])
    until = F.when(F.col("_done"), F.col("valid_until")).otherwise(F.least("valid_until", superseded, expired))
    return rows.withColumn("valid_until", until).select(*state.columns)


def match_facts(new: DataFrame, known: DataFrame, least: float = FACT_SIMILARITY) -> DataFrame:
    """new_id, id: the known fact of the same domain that each new one repeats; none is null.

    Equal, contained either way, or trigram similarity above the limit; the longest, then the likest.  Likeness is found by
    products of matrices over parts of a domain, which leave one row of each fact; contained texts meet by their rarest run.
    """
    asked = new.select("domain").distinct()

    def side(rows: DataFrame) -> DataFrame:
        text = F.lower(F.coalesce("content", F.lit("")))
        own = rows.join(asked, "domain", "left_semi").select("id", F.col("domain").alias("block"), text.alias("text"))
        return durable(own.withColumns({"n": F.length("text").cast("long"), "codes": similarity.codes(F.col("text"))}))

    n, k = side(new), side(known)
    like = similarity.longest_alike(n, k, least).select(F.col("l").alias("new_id"), F.col("r").alias("id"), "n", "like")
    inside = similarity.contained_pairs(n, k).select(F.col("o").alias("new_id"), F.col("i").alias("id"))
    around = similarity.contained_pairs(k, n).select(F.col("i").alias("new_id"), F.col("o").alias("id"))
    pairs = durable(inside.unionByName(around).where("new_id <> id").distinct().join(k.select("id", "n"), "id"))
    pairs = pairs.join(pairs.groupBy("new_id").agg(F.max("n").alias("n")), ["new_id", "n"])
    x, y = n.select(F.col("id").alias("new_id"), F.col("text").alias("_x")), k.select("id", F.col("text").alias("_y"))
    held = pairs.join(x, "new_id").join(y, "id").select("new_id", "id", "n", F.round(R.trigram_similarity("_x", "_y"), 9).alias("like"))
    best = like.unionByName(held).groupBy("new_id").agg(F.min(F.struct((-F.col("n")).alias("l"), (-F.col("like")).alias("s"), "id")).alias("m"))
    return new.select(F.col("id").alias("new_id")).join(best.select("new_id", "m.id"), "new_id", "left")


def clear_message(tables: dict[str, DataFrame], chat: str, index: int) -> dict[str, DataFrame]:
    """Every table without the rows of one message; participation goes with its events."""
    gone = (F.col("chat_id") == chat) & (F.col("message_index") == index)
    dropped = tables["events"].where(gone).select(F.col("id").alias("event_id"))
    out = {name: rows.where(~F.coalesce(gone, F.lit(False))) for name, rows in tables.items() if name != "participated"}
    return out | {"participated": tables["participated"].join(dropped, "event_id", "left_anti").select(*tables["participated"].columns)}


def clear_character(tables: dict[str, DataFrame], ids: list[str], chats: list[str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables (name -> rows with character_id and maybe chat_id) without a character's rows, and the counts removed."""
    out, counts = {}, None
    for name, rows in tables.items():
        gone = F.col("character_id").isin(ids)
        if chats and "chat_id" in rows.columns:
            gone &= F.col("chat_id").isin(chats)
        gone = F.coalesce(gone, F.lit(False))
        out[name] = rows.where(~gone)
        n = rows.where(gone).agg(F.lit(name).alias("table"), F.count("*").alias("removed"))
        counts = n if counts is None else counts.unionByName(n)
    return out, counts
