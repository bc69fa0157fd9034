"""Similar and contained texts against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from taleweave.operators import similarity, state


def test_jaccard_equals_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i, f"b{i % 2}", sorted({rng.randint(0, 25) for _ in range(rng.randint(0, 14))})) for i in range(120)]
    rows += [(200 + i, b, g) for i, b, g in rows[:10]]
    df = spark.createDataFrame(rows, "id int, block string, grams array<int>")
    for least in (0.0, 0.45, 0.5, 0.999):
        got = {(r.l, r.r) for r in similarity.jaccard_pairs(df, df, least).collect()}
        want = {(i, j) for i, b, x in rows for j, c, y in rows if b == c and set(x) & set(y) and round(len(set(x) & set(y)) / len(set(x) | set(y)), 9) > least}
        assert got == want


def test_containment_equals_all_pairs(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("ab c") for _ in range(400))
    rows = [(i, f"b{i % 2}", base[(a := rng.randint(0, 390)) : a + rng.choice([0, 1, 2, 3, 5, 11, 12, 13, 40, 200])]) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, block string, text string")
    got = sorted((r.o, r.i) for r in similarity.contained_pairs(df, df).collect())
    assert got == sorted((i, j) for i, b, x in rows for j, c, y in rows if b == c and y in x)


def test_no_pair_without_a_shared_key(spark):
    df = spark.createDataFrame([(i, "b", [100 * i + k for k in range(9)]) for i in range(50)], "id int, block string, grams array<int>")
    assert similarity.jaccard_pairs(df, df, 0.45).where("l <> r").count() == 0
    plan = similarity.jaccard_pairs(df, df, 0.45)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_facts_equal_all_pairs(spark, seed):
    from taleweave.functions import relevance as R

    rng = random.Random(seed)
    words = ["sea", "storm", "ship", "crew", "harbour", "a", "night", "captain"]
    rows = [(f"f{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 7))), rng.choice(["lore", "secret"])) for i in range(70)] + [("e", "", "lore"), ("n", None, "secret")]
    df = spark.createDataFrame(rows, "id string, content string, domain string")
    new = df.where("id < 'f3'")
    got = {r.new_id: r.id for r in state.match_facts(new, df).collect()}
    text = F.lower(F.coalesce("content", F.lit("")))
    side = lambda p: df.select(F.col("id").alias(p + "id"), F.col("domain").alias(p + "d"), text.alias(p + "t"), R.trigrams(text).alias(p + "g"))
    pairs = side("n").where("nid < 'f3'").crossJoin(side("k")).where("nd = kd AND nid <> kid")
    common = F.size(F.array_intersect("ng", "kg"))
    union = F.size("ng") + F.size("kg") - common
    pairs = pairs.withColumn("like", F.when(union > 0, F.round(common / union, 9)).otherwise(0.0)).where((F.col("like") > 0.45) | F.contains("nt", "kt") | F.contains("kt", "nt"))
    best = {}
    for r in pairs.collect():
        best[r.nid] = min(best.get(r.nid, (1, 0, "")), (-len(r.kt), -r.like, r.kid))
    assert got == {r[0]: best[r[0]][2] if r[0] in best else None for r in rows if r[0] < "f3"}


def test_nearest_rows_over_parts(spark, monkeypatch):
    """Equal vectors, null ones, ones without length and of another size, groups of several parts: as a loop over all rows."""
    import numpy as np

    from taleweave.operators import nearest, traits

    monkeypatch.setattr(nearest, "ROWS", 7)
    r = np.random.default_rng(5)
    rows = []
    for i in range(90):
        v = None if i % 13 == 3 else [0.0] * 3 if i % 17 == 4 else [1.0, 2.0] if i % 19 == 6 else [float(x) for x in np.float32(r.normal(size=3) if i % 4 else np.eye(3)[i % 3])]
        rows.append((i, "ab"[i % 5 == 0], "x", v))
    frame = spark.createDataFrame(rows, "id long, character_id string, category string, embedding array<float>")

    def like(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9)

    want = sorted((a[0], b[0], k + 1) for a in rows if a[0] % 3 == 0 for k, b in enumerate(sorted((b for b in rows if b[1] == a[1] and b[0] != a[0]), key=lambda b: (-like(a[3], b[3]), b[0]))[:3]))
    found = traits.nearest(frame.where("id % 3 = 0"), frame, 3)
    assert sorted((x["a_id"], x["b_id"], x["rank"]) for x in found.collect()) == want


def test_contained_texts_of_a_fold():
    """Texts shorter and longer than a window of runs, equal starts and ends: the pairs of a loop over all of them, from far fewer comparisons."""
    import random

    from taleweave.operators.traits import contained

    rng = random.Random(1)
    base = ["".join(rng.choice("abcde01") for _ in range(rng.choice([1, 3, 15, 46, 47, 48, 90, 400]))) for _ in range(150)]
    base += [x[a : a + n] for x in base if len(x) > 60 for a, n in ((0, 47), (5, 48), (10, 20), (len(x) - 50, 50))]
    texts = list(dict.fromkeys(x for x in base if x))
    want = [{j for j, y in enumerate(texts) if j != i and (x in y or y in x)} for i, x in enumerate(texts)]
    assert [set(x) for x in contained(texts)] == want
