"""Exact dedup by values: large and string ids, repeated and null ids, histories, against a plain loop."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from taleweave.llm import exact

BIG = 2**53 + 1
ROWS = [(BIG, "a b"), (BIG + 1, "ab"), (None, "a  b "), (None, None), (7, ""), (7, " \n"), (7, "x"), (8, "x"), (8, "x"), (9, "long " * 50_000), (10, "long" * 50_000), (None, "only"), (None, "only")]


def plain(rows):
    """The rows by digest, best first."""
    groups = {}
    for i, (d, t) in enumerate(rows):
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", "", t or "").encode()).hexdigest()
        groups.setdefault(key, []).append((-len(t or ""), d is None, d if d is not None else 0, i, d))
    return {k: sorted(g, key=lambda x: x[:3]) for k, g in groups.items()}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_values(spark, kind):
    rows = [(d if d is None or kind == "long" else f"id{d}", t) for d, t in ROWS]
    frame = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("digest", F.lit("clash")).withColumn("row", F.lit(1))
    got = exact.dedup(frame.repartition(3)).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got} == {d for d, _ in rows}
    groups = plain(rows) if kind == "long" else {k: [(n, m, rows[i][0] or "", i, d) for n, m, _, i, d in g] for k, g in plain(ROWS).items()}
    for key, group in groups.items():
        mine = [r for r in got if r["text_sha256"] == key]
        best = sorted(group, key=lambda x: x[:3])[0]
        best_id = rows[best[3]][0]
        assert len(mine) == len(group) == mine[0]["group_size"] and {r["keep_id"] for r in mine} == {best_id}
        assert [r["doc_id"] for r in mine if r["kept"]] == [best_id]
    kept = exact.keep_first(frame)
    assert kept.columns == frame.columns and kept.count() == len(groups)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(exact, "SHARD_KEYS", 40)
    monkeypatch.setattr(exact, "GROUP_ROWS", 25)
    rows = [(i, "same" if i % 3 == 0 else f"text{i // 2}{' ' * (i % 5)}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in exact.dedup(frame).collect()}
    for key, group in plain(rows).items():
        for *_, d in group:
            r = got[d]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (group[0][4], len(group), d == group[0][4], key)


def test_a_history_stays(spark):
    old = exact.durable(exact.build_index(exact.durable(exact.distinct(exact.digests(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"))))))
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact.dedup(spark.createDataFrame([(BIG, "ab"), (BIG + 1, "new"), (BIG + 2, "n e w")], "doc_id long, text string"), old).collect()}
    assert got == {BIG: (1, False), BIG + 1: (BIG + 2, False), BIG + 2: (BIG + 2, True)}
    none = exact.dedup(spark.createDataFrame([], "doc_id long, text string"), old)
    assert none.count() == 0
