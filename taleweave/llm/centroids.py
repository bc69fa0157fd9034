"""k-means on integer vectors, where each vector looks for its centroid within an annulus.

Centroids are sorted by norm.  A centroid nearer than an upper bound to a vector has a norm within that bound of the
vector's own (triangle inequality), so two binary searches in the sorted norms give the candidates, and only those are
compared, exactly, in integers.  The bound is the exact distance to the centroid whose norm is nearest the vector's.
Norms are floats, so the annulus is widened by what rounding can come to: a centroid just as far as the bound stays a
candidate, and ties go to the smaller number.

A round is one pass over a durable table of integers: each task sums its vectors by centroid and hands over one row for
each; the driver holds k centroids.  No vector moves, and no assignment is kept between rounds.

Defined results: vectors that are null, of another length, or with a component that is null or not finite aren't kept.
Components beyond +-2^27 count as that, so that each squared distance fits in a long; sums of distances stop at the
largest long.  Null ids count as empty text where the first centroids are drawn, and stay null; equal hashes (repeated
ids) go by components.  Fewer kept vectors than `K` give as many centroids; none give an empty result.  Repeated rows
count each time.  Centroids without vectors stay where they are.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import durable, table

WIDTH, K, ROUNDS, SCALE, SALT = 64, 40, 5, 256, "2:"
FARTHEST, LARGEST = 2**27, 2**63 - 1


def integers(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """The id and v, the kept vectors' components as integers."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    most = F.lit(float(FARTHEST))
    whole = lambda x: F.floor(F.greatest(-most, F.least(most, x.cast("double") * scale))).cast("int")
    return vectors.where((F.size(column) == width) & fine).select(id, F.transform(column, whole).alias("v"))


def first_centroids(rows: DataFrame, id: str = "vec_id", k: int = K, salt: str = SALT) -> np.ndarray:
    """The k vectors (a parameter, so the driver holds few) with the smallest hash of their ids."""
    found = rows.select(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64) if found else np.zeros((0, 0), np.int64)


class Annulus:
    """Nearest centroids by norm, with candidates only."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.centroids, self.norms = centroids[self.order], norms[self.order]

    @staticmethod
    def _apart(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = v - c
        return np.einsum("ij,ij->i", d, d)

    def __call__(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid and its squared distance for each vector, and how many distances were computed."""
        norms = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        near = np.clip(np.searchsorted(self.norms, norms), 1, max(len(self.norms) - 1, 1))
        near = np.minimum(near, len(self.norms) - 1)
        lower = np.maximum(near - 1, 0)
        near = np.where(norms - self.norms[lower] <= self.norms[near] - norms, lower, near)
        best, number = self._apart(v, self.centroids[near]), self.order[near]
        reach = np.sqrt(best.astype(np.float64)) + 1e-6 * (1 + norms)
        low, high = np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")
        compared = len(v)
        for j, (c, n) in enumerate(zip(self.centroids, self.order, strict=True)):
            rows = np.flatnonzero((low <= j) & (j < high) & (near != j))
            compared += len(rows)
            d = self._apart(v[rows], c)
            closer = (d < best[rows]) | (d == best[rows]) & (n < number[rows])
            best[rows[closer]], number[rows[closer]] = d[closer], n
        return number, best, compared


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _sums(rows: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, sums, compared) of each centroid with vectors; each task hands over a row for a centroid at most."""
    k, width = centroids.shape

    def run(batches):
        search, n, sums, compared = Annulus(centroids), np.zeros(k, np.int64), np.zeros((k, width), np.int64), 0
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            number, _, some = search(v)
            compared += some
            n += np.bincount(number, minlength=k)
            by = np.argsort(number, kind="stable")
            there, starts = np.unique(number[by], return_index=True)
            if len(there):
                sums[there] += np.add.reduceat(v[by], starts, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64())), pa.array(np.where(some == some[:1], compared, 0))], names=["cluster", "n", "sums", "compared"])

    parts = rows.select("v").mapInArrow(run, "cluster long, n long, sums array<long>, compared long")
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(width)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*total).alias("sums"), F.sum("compared").alias("compared")).collect()


def fit(rows: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after some rounds; `rows` is durable."""
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for r in _sums(rows, centroids.copy()):
            centroids[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows' id, cluster and distance (squared)."""
    id = next(c for c in rows.columns if c != "v")
    schema = StructType([rows.schema[id], StructField("cluster", IntegerType()), StructField("distance", LongType())])

    def run(batches):
        search = Annulus(centroids)
        for batch in batches:
            number, best, _ = search(_matrix(batch.column("v"), centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.array(number.astype(np.int32)), pa.array(best)], names=[id, "cluster", "distance"])

    return rows.mapInArrow(run, schema)


def clusters(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", width: int = WIDTH, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """The id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector."""
    rows = durable(integers(vectors, id, column, width))
    centroids = fit(rows, first_centroids(rows, id, k), rounds)
    if not len(centroids):
        nothing = rows.schema[id].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"`{id}` {nothing}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = durable(assign(rows, centroids))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(sums.values()), LARGEST)
    about = [(c, min(s, LARGEST), total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    each = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out, each with all distances."""
    apart = "list_sum(list_transform(list_zip(v.v, c.c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT"
    near = f"SELECT v.id, min(({apart}, c.k)) AS m FROM v CROSS JOIN c{{}} c GROUP BY v.id"
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SALT}' || vec_id::VARCHAR), v) - 1)::INT AS k, v AS c FROM v QUALIFY k < {K})"]
    for r in range(ROUNDS):
        steps.append(f"n{r} AS MATERIALIZED ({near.format(r)})")
        steps.append(f"""s{r} AS (SELECT k, list(q ORDER BY i) AS c FROM (SELECT n.m[2] AS k, i, ((sum(v.v[i]) - ((sum(v.v[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS q FROM n{r} n JOIN v USING (id) CROSS JOIN range(1, {WIDTH + 1}) t(i) GROUP BY 1, 2) GROUP BY k)""")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(s.c, c.c) AS c FROM c{r} c LEFT JOIN s{r} s USING (k))")
    steps.append(f"n{ROUNDS} AS MATERIALIZED ({near.format(ROUNDS)})")
    return f"""WITH {', '.join(steps)}
SELECT v.vec_id, n.m[2]::INT AS cluster, n.m[1] AS distance, sum(n.m[1]) OVER (PARTITION BY n.m[2])::BIGINT AS cluster_inertia, sum(n.m[1]) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM n{ROUNDS} n JOIN v USING (id) JOIN c{ROUNDS} c ON c.k = n.m[2]"""


SQL = _sql()
