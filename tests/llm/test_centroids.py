"""Clusters against a plain loop that compares every vector with every centroid."""

import hashlib
import math
import random

import numpy as np
import pytest

from taleweave.llm import centroids


def plain(rows, width=64, k=centroids.K, rounds=centroids.ROUNDS):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centers)):
            if some := [v for (_, v), o in zip(kept, own, strict=True) if o == n]:
                centers[n] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    last = [nearest(v) for _, v in kept]
    inertia = {n: sum(d for d, o in last if o == n) for n in range(len(centers))}
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, last, strict=True)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(n, width, seed=1, step=1.0):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, 1) * 4) * step / 4 for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize(("n", "width", "k", "step"), [(150, 64, 12, 1.0), (200, 3, 9, 0.25), (5, 4, 40, 1.0), (60, 2, 40, 0.004)])
def test_equals_the_plain_loop(spark, n, width, k, step):
    odd = [(None, [0.5] * width), (1000, None), (1001, [0.1] * (width + 1)), (1002, [float("nan")] * width), (1003, [None, *[0.5] * (width - 1)]), (1004, [float("inf"), *[0.5] * (width - 1)]), (1005, []), (3, [0.0] * width)]
    rows = vectors(n, width, step=step) + odd
    df = spark.createDataFrame([(i, v, 7, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int").repartition(4)
    assert found(centroids.clusters(df, width=width, k=k)) == plain(rows, width, k)


def test_boundary_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(2)
    centers = rng.integers(-3, 4, (30, 2))
    v = rng.integers(-4, 5, (500, 2))
    number, best, compared = centroids.Annulus(centers)(v)
    d = ((v[:, None] - centers[None]) ** 2).sum(2)
    assert (best == d.min(1)).all() and (number == d.argmin(1)).all() and compared < d.size


def test_nothing_kept_and_far_components(spark):
    none = spark.createDataFrame([(1, None)], "vec_id string, embedding array<float>")
    assert centroids.clusters(none.withColumn("vec_id", none.vec_id.cast("string"))).collect() == []
    far = centroids.clusters(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>"), k=1)
    assert {r.distance for r in far.collect()} == {64 * (1 << 54)}
