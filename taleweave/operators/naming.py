"""Which of many names stand in which of many texts, without comparing all names with all texts.

A name that stands in a text as a whole word brings each of its own words along as a whole word.  The word that fewest
names have is the name's one key; it meets the texts' words in an equi-join, and what meets is confirmed: at once, in the task that
reads the text, where the names were counted and are few enough to go there.  Names without
a word of ASCII letters, digits or underscores have their first two characters as key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import durable
from . import similarity

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(c: Column) -> Column:
    """ASCII letters only, as names are compared: other letters could become ASCII ones."""
    return F.translate(c, _UPPER, _UPPER.lower())


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_lower(c), F.lit("([a-z0-9_]+)"), F.lit(1)))


def mentioned_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, name_id: the names (name_id, name; two characters or more) that stand in the texts (id, text) as whole words, any case of ASCII letters.

    Null texts and names meet nothing; repeated rows give a pair once.
    """
    own = names.where(F.length("name") >= 2).select("name_id", "name", F.explode(F.when(F.size(_words(F.col("name"))) > 0, _words(F.col("name"))).otherwise(F.array(F.substring(_lower(F.col("name")), 1, 2)))).alias("key"))
    own = durable(own)
    common = own.groupBy("key").agg(F.count(F.lit(1)).alias("_df"))
    keys = durable(own.join(common, "key").groupBy("name_id", "name").agg(F.min(F.struct("_df", (-F.length("key")).alias("l"), "key")).alias("k")).select("name_id", "name", "k.key"))
    wordless = not keys.where(~F.col("key").rlike("^[a-z0-9_]+$")).isEmpty()
    said = F.array_union(_words(F.col("text")), similarity.runs(_lower(F.col("text")), 2)) if wordless else _words(F.col("text"))
    if keys.count() <= similarity.BROADCAST_ROWS:
        here = texts.where(F.col("text").isNotNull()).select("id", "text", F.explode(said).alias("key")).join(F.broadcast(keys), "key")
        return here.where(X.mentions(F.col("text"), F.col("name"))).select("id", "name_id").distinct()
    met = texts.where(F.col("text").isNotNull()).select("id", F.explode(said).alias("key")).join(keys, "key").select("id", "name_id", "name").distinct()
    return met.join(texts.select("id", "text"), "id").where(X.mentions(F.col("text"), F.col("name"))).select("id", "name_id").distinct()


def containing_either(left: DataFrame, right: DataFrame) -> DataFrame:
    """l, r: ids of texts of which one holds the other, by the rarest run of the shorter one.  left, right: id, text."""
    a, b = (rows.select("id", F.lit(0).alias("block"), "text").where(F.col("text").isNotNull()) for rows in (left, right))
    inside = similarity.contained_pairs(a, b).select(F.col("o").alias("l"), F.col("i").alias("r"))
    around = similarity.contained_pairs(b, a).select(F.col("i").alias("l"), F.col("o").alias("r"))
    return inside.unionByName(around).distinct()
