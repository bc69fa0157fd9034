"""Vectors as arrays: double arithmetic, no Python."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or the lengths differ."""
    size = norm(a) * norm(b)
    return F.when((size > 0) & (F.size(a) == F.size(b)), dot(a, b) / size).otherwise(0.0)


def cosine_to(a: Column, query: list[float]) -> Column:
    """Against a fixed vector, whose norm is worked out once."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    own = norm(a)
    return F.when((own > 0) & (F.lit(length) > 0) & (F.size(a) == len(query)), dot(a, q) / (own * F.lit(length))).otherwise(0.0)


def parse(c) -> Column:
    """'[1, 2, x]' to floats, what isn't a number to 0; null if there are no brackets."""
    c = F.col(c) if isinstance(c, str) else c
    inner = F.regexp_extract(c, r"^\s*\[(.*)\]\s*$", 1)
    parts = F.transform(F.split(inner, ","), lambda x: F.coalesce(F.trim(x).try_cast("double"), F.lit(0.0)))
    return F.when(c.rlike(r"^\s*\[.+\]\s*$"), parts)


def mean_vectors(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean for each key; null vectors don't count.  Partial sums go over the wire, not vectors."""
    parts = rows.where(F.col(vector).isNotNull()).select(key, F.posexplode(doubles(vector)).alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def embed_text(c, size: int = 64) -> Column:
    """The local stand-in for an embedding model: signed counts of hashed tokens, of length 1.  Null without tokens."""
    from .text import tokens

    hashes = F.transform(tokens(c), lambda w: F.xxhash64(w))
    sums = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(size)) == i), F.lit(0.0), lambda s, h: s + F.when(h < 0, -1.0).otherwise(1.0)))
    length = norm(sums)
    return F.when(length > 0, F.transform(sums, lambda x: x / length))
