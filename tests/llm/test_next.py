"""The next row in the order of ids: hot and clustered ids, and none in one task."""

import random

from pyspark.sql import functions as F

from taleweave.llm import fingerprints as fp


def check(spark, keys, monkeypatch, run_rows=20):
    monkeypatch.setattr(fp, "RUN_ROWS", run_rows)
    rows = [(k, f"t{i}") for i, k in enumerate(keys)]
    frame = spark.createDataFrame(rows, "k long, t string").repartition(7)
    got = fp.with_next(frame.withColumn("h", F.xxhash64("t")), "k", "t", ["k", "t"]).collect()
    order = sorted(((r["k"], r["h"], r["t"]) for r in got), reverse=True)
    assert len(got) == len(rows)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    assert all((r["next_k"], r["next_t"]) == (after[r["k"], r["h"], r["t"]][0], after[r["k"], r["h"], r["t"]][2]) for r in got)


def test_hot_keys(spark, monkeypatch):
    check(spark, [5] * 400 + list(range(-300, 300)) + [-(2**63)] * 300, monkeypatch)


def test_clustered_keys(spark, monkeypatch):
    rng = random.Random(1)
    check(spark, [2**62 + rng.randrange(10**6) for _ in range(500)] + [rng.randrange(100) for _ in range(300)] + [-(2**62)], monkeypatch)


def test_few_rows(spark, monkeypatch):
    check(spark, [7], monkeypatch)
    check(spark, [7, 7], monkeypatch)
    check(spark, [1, 2**63 - 1, -(2**63)], monkeypatch)


def test_runs_of_hot_keys_are_cut(spark):
    frame = spark.range(20_000).select(F.lit(3).cast("long").alias("k"), F.col("id").cast("string").alias("t"))
    cuts = [3] * 256
    place = fp._place(F.col("k"), (F.shiftright(F.xxhash64("t"), 11) + 2**52) / float(2**53), cuts, 3, 3)
    assert frame.select(F.floor(place)).distinct().count() > 400
