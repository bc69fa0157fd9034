"""Nearest vectors through cells: a coarse index that reads only the cells that a query probes.

Centroids are fitted on a bounded sample (`SAMPLE` rows, by the hash of their ids), each vector goes to the cell of the
centroid with the greatest cosine, and the index is a table partitioned by cell.  A query probes the cells of its nearest
centroids and ranks their vectors exactly; all cells are an exact scan.  Vectors without length go to cell -1, which no
query probes: their cosine is undefined.  Recall is measured by `recall`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import vector as V
from .nearest import nearest_rows

#: Rows that centroids are fitted on, rounds of fitting, rows of a file, and parts that each query's probes are dealt to.
SAMPLE, ROUNDS, FILE_ROWS = 20_000, 8, 200_000


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def fit(vectors: DataFrame, cells: int, id: str = "id", sample: int = SAMPLE) -> np.ndarray:
    """Centroids of unit length, at most `cells`; the driver holds the sample and them."""
    rows = vectors.where(F.col("embedding").isNotNull()).select("embedding").orderBy(F.xxhash64(F.col(id).cast("string")), F.col(id)).limit(sample).collect()
    m = _unit(np.array([r[0] for r in rows], np.float64)) if rows else np.zeros((0, 0))
    m = m[(m * m).sum(1) > 0.5] if len(m) else m
    centers = m[:cells].copy()
    for _ in range(ROUNDS if len(centers) else 0):
        own = (m @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, m)
        there = np.bincount(own, minlength=len(centers)) > 0
        centers[there] = _unit(sums)[there]
    return centers


def with_cell(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows and their cell (int)."""
    schema = StructType([*[f for f in rows.schema.fields if f.name != "cell"], StructField("cell", IntegerType())])

    def run(batches):
        for batch in batches:
            own = batch.select([n for n in batch.schema.names if n != "cell"])
            cell = np.full(batch.num_rows, -1, np.int32)
            lists = batch.column("embedding")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ok = np.flatnonzero(sizes == centroids.shape[1]) if len(centroids) else np.zeros(0, int)
            if len(ok):
                m = np.array(lists.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ok), -1)
                fine = np.isfinite(m).all(1) & ((m * m).sum(1) > 0)
                cell[ok[fine]] = (m[fine] @ centroids.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell)], names=[*own.schema.names, "cell"])

    return rows.mapInArrow(run, schema)


def write(rows: DataFrame, centroids: np.ndarray, path: str) -> DataFrame:
    """The index, partitioned by cell: a cell of very many vectors is spread over files of `FILE_ROWS`."""
    found = with_cell(rows, centroids)
    found.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(path)
    return rows.sparkSession.read.parquet(path)


def probes(centroids: np.ndarray, vector: list[float], n: int) -> list[int]:
    """The cells of the n centroids nearest a vector."""
    return (-(centroids @ np.asarray(vector, np.float64))).argsort(kind="stable")[:n].tolist()


def nearest(index: DataFrame, centroids: np.ndarray, vector: list[float], limit: int, n: int | None = None) -> DataFrame:
    """The index's rows with the greatest cosine, and similarity; n None looks into all cells."""
    rows = index if n is None else index.where(F.col("cell").isin(probes(centroids, vector, n)))
    rows = rows.where(F.col("embedding").isNotNull() & (F.col("cell") >= 0))
    return rows.withColumn("similarity", F.round(V.cosine_to(F.col("embedding"), vector), 9)).drop("embedding", "cell").orderBy(F.desc("similarity"), "id").limit(limit)


def knn_join(queries: DataFrame, index: DataFrame, centroids: np.ndarray, limit: int, n: int) -> DataFrame:
    """query, id, similarity: the `limit` nearest rows of the index for each query (query, embedding), from its n nearest cells.

    A query goes to its cells only; each part of a cell keeps the best rows of a query before they meet.
    """
    schema = StructType([queries.schema["query"], queries.schema["embedding"], StructField("cell", IntegerType())])

    def run(batches):
        for batch in batches:
            m = np.array(batch.column("embedding").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            own = (-(m @ centroids.T)).argsort(axis=1, kind="stable")[:, :n] if batch.num_rows else np.zeros((0, 0), int)
            at = np.repeat(np.arange(batch.num_rows), own.shape[1])
            some = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("query").take(some), batch.column("embedding").take(some), pa.array(own.ravel().astype(np.int32))], names=["query", "embedding", "cell"])

    asked = queries.select("query", "embedding").mapInArrow(run, schema)
    return nearest_rows(asked, index.where("cell >= 0").select("id", "cell", "embedding"), ["cell"], limit)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact pairs (query, id) that were found."""
    total = exact.count()
    return found.select("query", "id").join(exact.select("query", "id"), ["query", "id"], "left_semi").count() / total if total else 1.0
