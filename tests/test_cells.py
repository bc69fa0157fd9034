"""The vector index: recall against exact scans, partitions read, odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from taleweave.operators import cells

CELLS, PROBES = 32, 20


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    centers = cells.fit(rows, CELLS)
    return rows, centers, cells.write(rows, centers, str(tmp_path_factory.mktemp("cells") / "index"))


def test_recall_and_partitions(index):
    rows, centers, table = index
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query"), "embedding")
    found = cells.knn_join(queries, table, centers, 10, PROBES)
    exact = cells.knn_join(queries, table, centers, 10, CELLS)
    m = {r.id: np.array(r.embedding, float) for r in rows.collect()}
    ids = sorted(m)
    unit = np.array([m[i] / np.linalg.norm(m[i]) for i in ids])
    some = exact.where("query = 50").orderBy(F.desc("similarity"), "id").collect()
    like = np.round(unit @ unit[ids.index(50)], 9)
    assert [r.id for r in some] == [ids[k] for k in sorted(range(len(ids)), key=lambda k: (-like[k], ids[k]))[:10]]
    assert cells.recall(found, exact) >= 0.9


def test_one_query_reads_its_cells_only(index):
    rows, centers, table = index
    vector = [float(x) for x in rows.where("id = 7").first().embedding]
    near = cells.nearest(table, centers, vector, 5, 3)
    assert near.first().id == 7
    plan = near._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan or "PartitionFilters: [isnotnull(cell#" in plan
    assert [r.id for r in cells.nearest(table, centers, vector, 5).collect()][0] == 7


def test_odd_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [1.0]), (6, [0.9, 0.1])], "id int, embedding array<double>")
    centers = cells.fit(rows.where("id in (1, 6)"), 5)
    table = cells.write(rows, centers, f"{tmp_path}/i")
    assert {r.id for r in table.where("cell >= 0").collect()} == {1, 6} and table.count() == 6
    assert [r.id for r in cells.nearest(table, centers, [1.0, 0.0], 9, 5).collect()] == [1, 6]
    none = cells.fit(rows.where("false"), 5)
    assert len(none) == 0 and cells.with_cell(rows, none).where("cell >= 0").count() == 0
