"""Text relevance: OR rank, trigram similarity, reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

# Fixed values of the rank formula: the lowest weight class, and the sum of 1/j^2 over all j.
WEIGHT, ALL_SQUARES = 0.1, 1.64493406685
RRF_K, RECENCY = 60, 0.003
TRIGRAM_MATCH = 0.3


def or_rank(document, terms: list[str]) -> Column:
    """For each term with n occurrences 0.1 / 1.645 * (1 + 1/4 + ... + 1/n^2); the mean over the query's terms."""
    doc = tokens(document)
    total = F.lit(0.0)
    for t in terms:
        n = F.size(doc) - F.size(F.array_remove(doc, t))
        total = total + F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, j: s + F.lit(1.0) / (j * j))).otherwise(0.0)
    return total * (WEIGHT / ALL_SQUARES) / max(1, len(terms))


def matches_any(document, terms: list[str]) -> Column:
    return F.arrays_overlap(tokens(document), F.array(*[F.lit(t) for t in terms])) if terms else F.lit(False)


def trigrams(c) -> Column:
    """Distinct trigrams of each word, padded by two blanks before and one after."""
    padded = F.transform(tokens(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def trigram_similarity(a, b) -> Column:
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def reciprocal(rank: Column) -> Column:
    """Of a rank that starts at 1."""
    return F.lit(1.0) / (RRF_K + rank)
