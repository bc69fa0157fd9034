"""Model calls, and the merges of characters, on hand-made cases."""

import pickle

import pytest
from pyspark.sql import functions as F

from taleweave.operators import identity, models, traits


def test_backoff():
    calls, waits = [], []

    def fails(times, message):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise RuntimeError(message)
            return "done"

        return call

    assert models.with_backoff(fails(3, "status 503"), sleep=waits.append, draw=lambda: 0.5) == "done"
    assert waits == [0.5, 1.0, 2.0]
    calls.clear()
    with pytest.raises(RuntimeError):
        models.with_backoff(fails(9, "status 429"), sleep=lambda _: None)
    assert len(calls) == 5
    calls.clear()
    with pytest.raises(RuntimeError):
        models.with_backoff(fails(9, "bad request"), sleep=lambda _: None)
    assert len(calls) == 1


def test_bounded_and_log():
    b = models.Bounded(2)
    for k in ("a", "b", "a", "c"):
        b[k] = k
    assert list(b) == ["b", "c"] and list(pickle.loads(pickle.dumps(b))) == ["b", "c"]
    log = models.Log(3)
    for i in range(5):
        log.call(lambda p: p * 2, f"{i}" * 600, "extract")
    with pytest.raises(ZeroDivisionError):
        log.call(lambda p: 1 / 0, "x")
    rows = log.rows()
    assert [r["status"] for r in rows] == ["error", "ok", "ok"] and rows[1]["prompt"] == "4" * 500 and rows[1]["output_size"] == 1200
    log.clear()
    assert log.rows() == []


def test_verifier(spark):
    asked = []

    def generate(prompt):
        asked.append(prompt)
        if "odd" in prompt:
            return "perhaps"
        if "down" in prompt:
            raise RuntimeError("no")
        return "Answer: **KEEP_DISTINCT**" if '"keep"' in prompt else "REJECT_NEW." if '"noise"' in prompt else "merge"

    v = models.Verifier(generate, 2)
    assert [v(x, "y") for x in ("keep", "noise", "same", "odd", "down")] == ["KEEP", "REJECT", "MERGE", "MERGE", "MERGE"]
    n = len(asked)
    assert v("same", "y") == "MERGE" and len(asked) == n and v("keep", "y") == "KEEP" and len(asked) == n + 1
    data = [(1, "aaa", [1.0, 0.0]), (2, "noise", [0.78, 0.62]), (3, "keep", [0.77, 0.63])]
    t = spark.createDataFrame([("a", "p", i, c, x) for i, c, x in data], "character_id string, category string, id long, content string, embedding array<double>")
    fold = traits.fold(t, verdict=models.Verifier(lambda p: "REJECT_NEW" if '"noise"' in p else "KEEP_DISTINCT"))
    assert sorted((r.id, r.canonical_id) for r in fold.collect()) == [(1, None), (3, None)]


def test_repoint_keeps_the_own_row(spark):
    rows = spark.createDataFrame([("a", "e1", 1), ("b", "e1", 2), ("c", "e1", 3), ("b", "e2", 4), ("c", "e2", 5), ("b", None, 6), ("c", None, 7), ("z", "e1", 8), ("z", "e1", 9)], "who string, event string, n int")
    ids = spark.createDataFrame([("b", "a"), ("c", "a")], "old string, new string")
    assert sorted(r.n for r in identity.repoint(rows, "who", ids, ["who", "event"]).collect()) == [1, 4, 6, 7, 8, 9]
    assert {r.who for r in identity.repoint(rows, "who", ids, ["who", "event"]).collect()} == {"a", "z"}
    assert identity.repoint(rows, "who", ids, []).where("who = 'a'").count() == 7


def test_merged_characters(spark):
    people = spark.createDataFrame([("a", "Ann", ["annie"], ""), ("b", "Anna", None, "tall"), ("c", "Bo", [], "x")], "id string, name string, aliases array<string>, description string")
    threads = spark.createDataFrame([(1, ["b", "a", "c"]), (2, ["c", "b"]), (3, None), (4, ["d", "c"])], "id int, involved_chars array<string>")
    ids = spark.createDataFrame([("b", "a")], "old string, new string")
    out = identity.merge_characters({"characters": people, "plot_threads": threads}, ids)
    assert sorted((r.id, r.name, tuple(r.aliases), r.description) for r in out["characters"].collect()) == [("a", "Ann", ("Anna", "annie"), "tall"), ("c", "Bo", (), "x")]
    assert {r.id: r.involved_chars for r in out["plot_threads"].collect()} == {1: ["a", "c"], 2: ["a", "c"], 3: None, 4: ["d", "c"]}


def test_upsert_finds_names_before_aliases(spark):
    schema = "id string, chat_id string, name string, aliases array<string>, description string"
    known = spark.createDataFrame([("1", "c", "Ann", ["boss", "annie"], "old"), ("2", "c", "Boss", [], "b"), ("3", "d", "Ann", [], "other chat"), ("4", None, "Ann", [], "global")], schema)
    batch = spark.createDataFrame([("c", "boss", ["Chief", "Ann"], ""), ("c", "Annie", ["the  Lady"], "new"), ("c", "Cy", None, "fresh"), ("e", "Ann", ["Ann"], "")], "chat_id string, name string, aliases array<string>, description string")
    got = {r.id: (r.chat_id, r.name, r.aliases, r.description) for r in identity.upsert(known, batch).collect()}
    # a name beats an alias; where two names match, the one with more aliases; another row's name is no alias
    assert got["1"][1:] == ("Ann", ["Annie", "Chief", "annie", "boss", "the  Lady"], "new")
    assert got["2"][1:] == ("Boss", [], "b") and got["3"] == ("d", "Ann", [], "other chat") and got["4"][3] == "global"
    fresh = {v[1]: v for k, v in got.items() if len(k) > 1}
    assert fresh["Cy"] == ("c", "Cy", ["Cy"], "fresh") and fresh["Ann"][0] == "e" and len(got) == 6


def test_context_of_neighbours(spark):
    rows = [(i, "c", f"n{i}", i, f"t{i}", "old" if i == 3 else None) for i in range(12)] + [(20, "d", "n", 0, "alone", None), (21, None, "n", 0, "nowhere", None)]
    memory = spark.createDataFrame(rows, "id int, chat_id string, node_id string, message_index int, content string, context_prefix string")
    got = {r.id: r.context_prefix for r in models.backfill_context(memory, lambda chat, around, text: F.when(text != "t5", F.concat_ws("/", chat, around))).collect()}
    assert got[3] == "old" and got[5] is None and got[20] == "d/alone" and got[21] is None
    assert got[0] == "c/" + "\n---\n".join(f"t{i}" for i in range(5)) and got[11] == "c/" + "\n---\n".join(f"t{i}" for i in range(7, 12))
