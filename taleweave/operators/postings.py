"""An inverted index of texts: a row for each chat, text and term, with the term's places in the text.

It is built in one pass that moves no text: a task analyses its texts and hands over their postings.  Written, it is
dealt by ranges of (chat, term, text), so a chat or a term of very many texts is spread over files, and a search reads the
row groups of its own chats and terms.  Ranking is a filter on terms and a sum by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import english
from ..functions import relevance as R

KIND = ArrayType(StructType([StructField("term", StringType()), StructField("places", ArrayType(IntegerType()))]))


@F.arrow_udf(KIND)
def _postings(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in english.slices(batches):
        rows, terms, places, ends = [0], [], [], [0]
        for t in texts.to_pylist():
            own: dict[str, list[int]] = {}
            for term, at in zip(*english.lexemes(t), strict=True):
                own.setdefault(term, []).append(at)
            for term in sorted(own):
                terms.append(term)
                places += own[term]
                ends.append(len(places))
            rows.append(len(terms))
        one = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))], names=["term", "places"])
        yield pa.ListArray.from_arrays(pa.array(rows, pa.int32()), one)


def postings(text) -> Column:
    """A text's terms in alphabetical order, each with its places: what the database's text vector holds."""
    return _postings(F.col(text) if isinstance(text, str) else text)


def vector_text(found: Column) -> Column:
    """Postings as the database prints them: 'term':1,5 'other':2."""
    return F.array_join(F.transform(found, lambda p: F.concat(F.lit("'"), p["term"], F.lit("':"), F.array_join(p["places"].cast("array<string>"), ","))), " ")


def build(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """The keys (chat_id, id and what a hit shows), term and places."""
    return rows.select(*keys, F.inline(postings(text)))


def write(index: DataFrame, path: str, by: tuple[str, ...] = ("chat_id", "term", "id"), parts: int | None = None) -> DataFrame:
    """The index as a table, dealt and sorted by chat, term and text; what was there is replaced."""
    dealt = index.repartitionByRange(parts, *by) if parts else index.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def score(n: Column) -> Column:
    """Of n occurrences: 1 + 1/4 + ... + 1/n^2."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, j: s + F.lit(1.0) / (j * j))).otherwise(0.0)


def or_rank(times: Column) -> Column:
    """Of a text's counts of each of a query's terms: the mean over the terms."""
    return F.aggregate(F.transform(times, score), F.lit(0.0), lambda s, x: s + x) * (R.WEIGHT / R.ALL_SQUARES) / F.greatest(F.size(times), F.lit(1))


def ranked(index: DataFrame, terms: list[str], limit: int, keys: tuple[str, ...] = ("id", "chat_id", "message_index")) -> DataFrame:
    """The keys and rank of the best texts that have any of the query's terms (stems, distinct)."""
    if not terms:
        return index.where(F.lit(False)).select(*keys, F.lit(0.0).alias("rank"))
    found = index.where(F.col("term").isin(terms)).groupBy(*keys).agg(F.sum(score(F.size("places"))).alias("s"))
    return found.select(*keys, F.round(F.col("s") * (R.WEIGHT / R.ALL_SQUARES) / len(terms), 9).alias("rank")).orderBy(F.desc("rank"), "id").limit(limit)


def phrase(index: DataFrame, terms: list[str], keys: tuple[str, ...] = ("id", "chat_id")) -> DataFrame:
    """The keys of texts where the terms stand one after the other: a term's places less its place in the phrase meet in one."""
    wanted = F.create_map(*[x for i, t in enumerate(terms) for x in (F.lit(t), F.lit(i))]) if len(set(terms)) == len(terms) else None
    if wanted is None:
        raise ValueError("a phrase of distinct terms")
    starts = index.where(F.col("term").isin(terms)).select(*keys, "term", F.explode("places").alias("_p")).withColumn("_p", F.col("_p") - wanted[F.col("term")])
    return starts.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(terms)).select(*keys).distinct()
