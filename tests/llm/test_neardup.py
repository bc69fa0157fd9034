"""Near-duplicates by values: repeated, null, large and string ids, and hot bands whose classes aren't linked."""

import random

import pytest
from pyspark.sql import functions as F

from taleweave.llm import neardup

BIG = 2**53 + 1
LONG = " ".join(f"w{i % 7919}" for i in range(100_000))
ROWS = [(1, "a b c d"), (1, "x y z w"), (2, "a b c d"), (BIG, LONG), (BIG + 1, LONG + " end"), (None, "a b  C d"), (None, "q r s t"), (None, "q r s t"), (None, None), (5, ""), (5, ""), (6, "q r s t")]


def brute(rows, percent=85, k=3):
    """component of each row: the smallest id of the rows that its links reach."""
    words = [(t or "").lower().split() for _, t in rows]
    sets = [frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []) for w in words]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    lowest = {}
    for g, (d, _) in zip(group, rows):
        if d is not None:
            lowest[g] = min(lowest.get(g, d), d)
    return [lowest.get(g) for g in group]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_values(spark, kind):
    rows = [(d if d is None or kind == "long" else f"{d:020d}", t) for d, t in ROWS]
    frame = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("id", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("empty", F.lit(2))
    got = neardup.link(frame, 3, 85).collect()
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    want = sorted(((d, c, d == c) for (d, _), c in zip(rows, brute(rows), strict=True)), key=key)
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=key) == want
    kept = neardup.keep_one(frame, 3, 85)
    assert kept.columns == frame.columns
    texts = sorted(t or "" for _, t in ((r["doc_id"], r["text"]) for r in kept.collect()))
    assert texts == sorted(["a b c d", "x y z w", LONG, "q r s t", "", "", ""])


def test_hot_bands(spark, monkeypatch):
    """Hundreds of texts share most of their words, pairwise below the threshold; some have copies above it."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "PART", 4)
    rng = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = common + [f"o{i}_{j}" for j in range(rng.choice((4, 8, 14)))]
        rows.append((len(rows), " ".join(own)))
        for _ in range(rng.choice((0, 0, 1, 3))):
            rows.append((len(rows), " ".join(own[: -rng.randint(1, 3)])))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.link(frame, 3, 85).collect()}
    assert got == {d: c for (d, _), c in zip(rows, brute(rows), strict=True)}
    monkeypatch.setattr("taleweave.llm.common.BROADCAST_ROWS", 0)
    assert {r["doc_id"]: r["component_id"] for r in neardup.link(frame, 3, 85).collect()} == got


def test_links_of_a_group_become_trees(spark, monkeypatch):
    """Many links for an id, as the blocks of a large group give them: one an id is left, and the components stay."""
    rng = random.Random(6)
    pairs = [(g * 1000 + rng.randrange(100), g * 1000 + rng.randrange(100)) for g in range(3) for _ in range(4000)] + [(7, 7), (5000, 4000), (4000, 6000)]
    frame = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    ids = {x for a, b in pairs if a != b for x in (a, b)}
    want = {x: 4000 if x in (4000, 5000, 6000) else min(y for y in ids if y // 1000 == x // 1000) for x in ids}
    for most in (neardup.TREES, 150):
        monkeypatch.setattr(neardup, "TREES", most)
        found = neardup.trees(frame)
        assert found.where("a >= b").isEmpty() and found.count() <= len(ids) * (1 if most > 150 else 3)
        assert {r["id"]: r["component"] for r in neardup.components(frame).collect()} == want
