"""Names in texts, against each name with each text."""

import random
import re

from taleweave.operators import naming


def brute(texts, names):
    edge = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    return sorted({(i, j) for i, t in texts for j, n in names if t is not None and n is not None and len(n) >= 2 and re.search(edge[0] + re.escape(n) + edge[1], t, re.I | re.A)})


def test_equals_all_pairs(spark):
    rng = random.Random(1)
    words = ["Ann", "ann", "Old", "Tom", "the", "of", "Bo", "b", "#7", "x_1", "東京", "é", "İBo", "!!", "KelvinK", "Anna"]
    make = lambda n: rng.choice([" ", "-", "  ", ""]).join(rng.choice(words) for _ in range(n))
    texts = [(i, make(rng.randint(0, 12))) for i in range(120)] + [(500, None), (501, ""), (3, make(5))]
    names = [(f"n{i}", make(rng.randint(1, 3))) for i in range(60)] + [("z", None), ("e", ""), ("w", "!!"), ("k", "東京"), ("n1", "Tom")]
    got = naming.mentioned_in(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(names, "name_id string, name string"))
    assert sorted((r.id, r.name_id) for r in got.collect()) == brute(texts, names)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_either_contains(spark):
    rng = random.Random(2)
    make = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(0, 16)))
    left, right = [(i, make()) for i in range(60)], [(i, make()) for i in range(60)]
    got = naming.containing_either(spark.createDataFrame(left, "id int, text string"), spark.createDataFrame(right, "id int, text string"))
    assert sorted((r.l, r.r) for r in got.collect()) == sorted((i, j) for i, x in left for j, y in right if x in y or y in x)


def test_no_texts_or_names(spark):
    none, one = spark.createDataFrame([], "id int, text string"), spark.createDataFrame([("n", "Ann")], "name_id string, name string")
    assert naming.mentioned_in(none, one).collect() == []
    assert naming.mentioned_in(spark.createDataFrame([(1, "Ann")], "id int, text string"), one.where("false")).collect() == []
