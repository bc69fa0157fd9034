"""Removal of repeated words against a plain loop over all windows."""

import hashlib
import random

import pytest

from taleweave.llm import repeats


def plain(rows, window=repeats.WINDOW):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            if i is not None and (s not in first or first[s] is None or i < first[s]):
                first[s] = i
            first.setdefault(s, None)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            m = first[tuple(w[k : k + window])]
            if m is not None and (i is None or m < i):
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["é", "東京", "a b"]
    shared = [[rng.choice(words) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    line = [rng.choice(words) for _ in range(8)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            text += rng.choice(shared) if kind < 0.4 else line if kind < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 40))]
        rows.append((i * 7 % 131, rng.choice([" ", "  ", "\n", "\t "]).join(text)))
    return rows + rows[:9] + [(900 + i, t) for i, (_, t) in enumerate(rows[:20])]


@pytest.mark.parametrize(("seed", "crowd"), [(1, repeats.CROWD), (2, 3), (3, 0)])
def test_equals_the_plain_loop(spark, seed, crowd):
    rows = [*corpus(seed), (None, "null id"), (None, corpus(seed)[3][1]), (5000, None), (5001, ""), (5002, " \n"), (5003, " ".join(["same"] * 40)), (5004, " ".join(["same"] * 12)), (5005, " ".join(["same"] * 13))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, first int").repartition(5)
    assert found(repeats.without_repeats(docs, crowd=crowd)) == plain(rows)


def test_ids_of_text_keep_their_type_and_order(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [("b", passage + " end"), ("a", "start " + passage), ("c", passage)]
    out = repeats.without_repeats(spark.createDataFrame(rows, "doc_id string, text string"))
    assert found(out) == plain(rows) and [r.n_removed for r in out.orderBy("doc_id").collect()] == [0, 30, 30]


def test_a_very_long_text_and_an_empty_table(spark):
    long = " ".join(f"l{k}" for k in range(60_000))
    rows = [(1, long), (2, "before " + long + " after"), (3, " ".join(f"l{k}" for k in range(100, 112)))]
    assert found(repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_automaton_knows_the_smallest_text_of_each_window():
    rng = random.Random(4)
    texts = [[rng.randint(0, 3) for _ in range(rng.randint(1, 40))] for _ in range(30)]
    auto = repeats.Automaton(texts[5:], list(range(len(texts) - 5)))
    for t in texts:
        want = [min((r for r, u in enumerate(texts[5:]) if any(u[j : j + 4] == t[k : k + 4] for j in range(len(u) - 3))), default=1 << 62) for k in range(len(t) - 3)]
        assert auto.statistics(t, 4) == want


def test_equal_windows_have_equal_anchors():
    words = [f"w{k % 17}".encode() for k in range(60)]
    own, h, at, n = repeats.anchors([[b"x"], words, [], [b"other", *words[5:40]]])
    seen = {}
    for d, x, i, m in zip(own.tolist(), h.tolist(), at.tolist(), n.tolist(), strict=True):
        for k in range(i, i + m):
            w = tuple((words if d == 1 else [b"other", *words[5:40]])[k : k + 13])
            assert seen.setdefault(w, x) == x
    assert n.sum() == 48 + 24
