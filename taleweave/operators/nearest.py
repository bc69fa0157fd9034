"""The nearest vectors of a group for each query: groups are dealt into parts, and a part is one product of matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows of a part (about), and queries that are compared with it at once.
ROWS, TILE = 8192, 256
#: How far a product may be from the sum that ranks.
CLOSE = 3e-9


def units(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 (0 if there is none, or it has no length), filled up with zeros; and how many components each has."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    for d in np.unique(sizes[sizes > 0]):
        own = np.flatnonzero(sizes == d)
        m = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), d)
        length = np.sqrt((m * m).sum(1))[:, None]
        out[own, :d] = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    return out, sizes


def _best(q: np.ndarray, q_sizes: np.ndarray, m: np.ndarray, sizes: np.ndarray, rank: np.ndarray, banned: np.ndarray, k: int):
    """(query, row, similarity) of the k best rows by similarity, then rank.  banned: a row that a query doesn't take, or -1."""
    dims = min(q.shape[1], m.shape[1])
    q, m = q[:, :dims], m[:, :dims]
    differ = len(np.unique(np.concatenate([q_sizes, sizes]))) > 1
    for start in range(0, len(q), TILE):
        part = q[start : start + TILE]
        like = part @ m.T
        if differ:
            like[q_sizes[start : start + TILE, None] != sizes] = 0.0
        own = banned[start : start + TILE]
        like[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
        least = np.partition(like, -k, axis=1)[:, -k] if k < like.shape[1] else np.full(len(like), -2.0)
        r, c = np.nonzero(like >= np.maximum(least, -2.0)[:, None] - CLOSE)
        exact = np.zeros(len(r))
        for a in range(0, len(r), 100_000):
            exact[a : a + 100_000] = np.einsum("ij,ij->i", part[r[a : a + 100_000]], m[c[a : a + 100_000]])
        if differ:
            exact[q_sizes[start + r] != sizes[c]] = 0.0
        exact = np.round(exact, 9)
        by = np.lexsort((rank[c], -exact, r))
        r, c, exact = r[by], c[by], exact[by]
        there = np.arange(len(r)) - np.searchsorted(r, r) < k
        yield r[there] + start, c[there], exact[there]


def nearest_rows(queries: DataFrame, rows: DataFrame, by: list[str], k: int, but_own: bool = False) -> DataFrame:
    """query, id, similarity (rounded to 9 digits): the k nearest rows of each query among those of its group, the smallest id of equals.

    queries: by, query, embedding; rows: by, id, embedding.  but_own: not the row of the query's own id.  Vectors that are
    null, without length or of another size are 0 like.  Large groups are dealt by their ids, so that no task holds one.
    """
    parts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("_parts"))
    r = rows.join(parts, by).select(*by, F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("_part"), F.lit(False).alias("_asks"), "id", F.lit(None).cast(queries.schema["query"].dataType).alias("query"), F.col("embedding").cast("array<double>").alias("embedding"))
    q = queries.join(parts, by).select(*by, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(True).alias("_asks"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "query", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = StructType([StructField("query", queries.schema["query"].dataType), StructField("id", rows.schema["id"].dataType), StructField("similarity", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches)).combine_chunks()
        asks, there = group.filter(group.column("_asks")), group.filter(pc.invert(group.column("_asks")))
        if not asks.num_rows or not there.num_rows:
            return
        name, ids = asks.column("query").combine_chunks(), there.column("id").combine_chunks()
        (x, nx), (y, ny) = (units(t.column("embedding").combine_chunks()) for t in (asks, there))
        rank = np.empty(len(ids), int)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        own = pc.index_in(name, ids).fill_null(-1).to_numpy(zero_copy_only=False) if but_own else np.full(len(name), -1)
        for a, b, like in _best(x, nx, y, ny, rank, own, k):
            yield pa.RecordBatch.from_arrays([name.take(pa.array(a)), ids.take(pa.array(b)), pa.array(like)], names=["query", "id", "similarity"])

    found = q.unionByName(r).groupBy(*by, "_part").applyInArrow(run, schema)
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("_r", order).where(F.col("_r") <= k).drop("_r")
