"""Operators on hand-made tables."""

import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from taleweave.operators import arcs, graph, identity, search, state, traits
from taleweave.sources import chat
from taleweave.streaming import ingest

T0 = dt.datetime(2024, 1, 1)
STATE = "id long, chat_id string, key string, value string, valid_from timestamp_ntz, valid_until timestamp_ntz, source_message_index int"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def changes(spark, *items):
    return spark.createDataFrame([(i, c, k, v, T0 + dt.timedelta(hours=n), None, n) for i, (c, k, v, n) in enumerate(items)], STATE)


def test_versions_close_and_dont_overlap(spark):
    old = state.apply_changes(spark.createDataFrame([], STATE), changes(spark, ("a", "Gate State", "open", 1), ("a", "gate", "shut", 2), ("b", "gate", "open", 1)))
    new = state.apply_changes(old, changes(spark, ("a", "gate", "shut", 5)).withColumn("id", F.col("id") + 10))
    assert new.where("valid_until IS NULL").count() == 2
    got = rows(new.where("chat_id = 'a'"), "valid_from", "valid_until")
    assert all(a[1] == b[0] for a, b in zip(got, got[1:])) and got[-1][1] is None


def test_supersede_and_expire(spark):
    s = state.apply_changes(spark.createDataFrame([], STATE), changes(spark, ("a", "ship", "sails", 1), ("a", "weather", "rain", 2), ("a", "king", "Bo", 1)))
    at = F.lit(T0).cast("timestamp_ntz")
    assert rows(state.expire(s, F.lit(14), at).where("valid_until IS NULL"), "key") == [("king",), ("weather",)]  # 13 and exactly 12
    assert rows(state.supersede(s, "a", ["King", "nothing"], at).where("valid_until IS NULL"), "key") == [("ship",), ("weather",)]


def test_merge_twice_is_once(spark):
    table = spark.createDataFrame([("a", "x", 1), ("b", "", 5)], "id string, name string, size int")
    batch = spark.createDataFrame([("a", "", 3), ("c", "z", 2)], "id string, name string, size int")
    rules = {"name": state.keep_filled, "size": state.greatest}
    once = state.merge(table, batch, ["id"], rules)
    assert rows(once, "id", "name", "size") == [("a", "x", 3), ("b", "", 5), ("c", "z", 2)]
    assert rows(state.merge(once, batch, ["id"], rules), "id", "name", "size") == rows(once, "id", "name", "size")


def test_time_of_event_is_trimmed(spark):
    """Blank times keep the old one; others lose the white space around them, in new rows too, by one batch or folded."""
    schema = "id string, world_time string"
    table = spark.createDataFrame([("a", "noon"), ("b", "noon")], schema)
    batch = spark.createDataFrame([("a", " later\u00a0\n"), ("b", " \t"), ("c", "\u3000dusk "), ("d", " ")], schema)
    want = [("a", "later"), ("b", "noon"), ("c", "dusk"), ("d", None)]
    assert rows(state.merge(table, batch, ["id"], state.EVENT_RULES), "id", "world_time") == want
    twice = batch.withColumns({"message_index": F.lit(1), "ord": F.lit(0)}).unionByName(batch.select("id", F.lit("\t").alias("world_time"), F.lit(2).alias("message_index"), F.lit(0).alias("ord")))
    assert rows(state.merge(table, state.fold(twice, ["id"], ["id", "world_time"], state.EVENT_RULES), ["id"], state.EVENT_RULES), "id", "world_time") == want


def test_breadth_first(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "y")], "src string, dst string").withColumns({"src_type": F.lit("t"), "dst_type": F.lit("t"), "edge": F.lit("e")})
    seeds = spark.createDataFrame([("a", "t")], "id string, type string")
    assert rows(graph.expand(e, seeds, 2), "id", "hop") == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(graph.expand(e, seeds, 5), "id", "hop") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    pairs = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    assert rows(graph.neighbourhood(pairs, seeds.select("id"), 1), "id", "hop") == [("a", 0), ("b", 1), ("d", 1)]


def test_edges_are_found_once(spark):
    """Both ways come from one pass over their rows."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), (None, "x")], "src string, dst string").mapInArrow(count, "src string, dst string")
    both = graph._edge(pairs, "e", "src", "t", "dst", "u", True)
    assert rows(both, "src", "src_type", "dst", "dst_type") == [("a", "t", "b", "u"), ("b", "t", "c", "u"), ("b", "u", "a", "t"), ("c", "t", "d", "u"), ("c", "u", "b", "t"), ("d", "u", "c", "t")]
    assert seen.value == 4


def test_backfill_pairs_no_tables(spark):
    """Rows without an embedding are found without a product of documents and embeddings."""
    from taleweave.plans import catalog

    found = catalog.QUERIES["up_backfill_emb"](spark, "/root/testdata/sf0.001")
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_fusion(spark):
    hit = lambda ids: spark.createDataFrame([(i, "c", n, 1.0 - n / 10) for n, i in enumerate(ids)], "id string, chat_id string, message_index int, s double")
    order = [F.desc("s"), "id"]
    fused = search.fuse({"memory_vector": ("memory", hit(["p", "q"]), order), "memory_text": ("memory", hit(["q", "r"]), order), "event_text": ("event", hit(["p"]), order)})
    got = {(r.kind, r.id): (r.score, r.source) for r in fused.collect()}
    assert got[("memory", "q")][0] == round(1 / 61 + 1 / 62, 9) and got[("memory", "q")][1] == "memory_vector"
    assert got[("event", "p")] == (round(1 / 61, 9), "event_text")
    capped = search.cap_kinds(fused, {"memory": 2, "event": 0}, 10, ["place", "rank", "id"])
    assert [r.id for r in capped.collect()] == ["q", "p"]
    assert search.cap_kinds(fused, {"memory": 5, "event": 5}, 1, ["place", "rank", "id"]).count() == 1


def test_budgets_and_scope():
    assert search.resolve_budgets(None, "unknown")["chars"] == 3000
    assert search.resolve_budgets({"budgets": {"panel": {"memory": 7}}}, "panel", {"event": 2}) == {"memory": 7, "event": 2, "dialogue": 5, "snapshot": 0, "chars": 1500}
    assert search.scope(None) == [] and search.scope("a") == ["a"] and search.scope(["a", "", None, 3]) == ["a"]


def test_resolution(spark):
    people = spark.createDataFrame([("1", "Ann of X", "annie", "c"), ("2", "Ann of X", None, None), ("3", "Bo", None, "c"), ("4", "Captain Bolder", None, "c")], "id string, name string, alias string, chat_id string")
    names = spark.createDataFrame([("ANN  of x",), ("annie",), ("the Captain Bolder himself",), ("zz",), (" ",)], "name string")
    got = rows(identity.resolve(people, names, ["c"], False), "name", "id", "how")
    assert got == [("ANN  of x", "1", "exact"), ("ANN  of x", "2", "exact"), ("annie", "1", "exact"), ("the Captain Bolder himself", "4", "contained")]
    assert identity.resolve(people, names, ["c"]).where("how = 'fallback'").count() == 8


def test_planted_partition():
    edges = [(i, j, 1.0) for g in (range(5), range(5, 10)) for i in g for j in g if i < j] + [(0, 5, 0.1)]
    a, b, w = (np.array(x) for x in zip(*edges))
    found = arcs.louvain(a, b, w, 10, 1.0)
    assert len(set(found)) == 2 and len(set(found[:5])) == 1 and len(set(found[5:])) == 1
    assert (arcs.louvain(a, b, w, 10, 1.0) == found).all()


def test_small_communities_go(spark):
    ids = [f"e{i}" for i in range(7)]
    events = spark.createDataFrame([("c", x, i) for i, x in enumerate(ids)] + [("few", "f1", 0), ("few", "f2", 1)], "chat_id string, id string, message_index int")
    w = spark.createDataFrame([("c", a, b, 1.0) for a, b in (("e0", "e1"), ("e1", "e2"), ("e0", "e2"), ("e5", "e6"))], "chat_id string, a string, b string, w double")
    assert rows(arcs.communities(events, w, 1.0), "chat_id", "id", "community") == [("c", "e0", 0), ("c", "e1", 0), ("c", "e2", 0)]


def test_trait_fold(spark):
    data = [(1, "brave", [1.0, 0.0]), (2, "very brave", [0.0, 1.0]), (3, "bold", [0.9, 0.1]), (4, "shy", [0.0, -1.0])]
    t = spark.createDataFrame([("a", "p", i, c, v) for i, c, v in data], "character_id string, category string, id long, content string, embedding array<double>")
    assert rows(traits.fold(t), "id", "merged_count") == [(1, 2), (2, 0), (3, 0), (4, 0)]
    assert rows(traits.fold(t).where("canonical_id IS NOT NULL"), "id", "canonical_id") == [(2, 1), (3, 1)]


def test_chat_files(spark, tmp_path):
    lines = [{"character_name": "A", "user_name": "U"}, {"name": "U", "is_user": True, "mes": "hi"}, {"name": "S", "is_system": True, "mes": "x"}, {"name": "A", "is_user": False, "mes": "old", "swipe_id": 1, "swipes": ["old", "new"]}]
    (tmp_path / "A - 2024-01-02.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    read = chat.read_chats(spark, str(tmp_path))
    assert [tuple(r) for r in chat.messages(read).orderBy("message_index").select("message_index", "name", "mes").collect()] == [(0, "U", "hi"), (1, "A", "new")]
    assert read.where("malformed").count() == 1
    assert chat.chat_list(read).first()["date"] == "2024-01-02"
    assert [r.batch for r in chat.batches(chat.messages(read), -3).orderBy("batch").collect()] == [0, 1]


def test_lorebook(spark, tmp_path):
    book = {"entries": {"1": {"disable": False, "content": "The town lies by {{char}}'s river", "comment": "Millford", "key": ["mill"]}, "2": {"disable": True, "content": "x"}, "3": {"content": "  "}}}
    (tmp_path / "b.json").write_text(json.dumps(book))
    (row,) = chat.read_lorebook(spark, str(tmp_path / "b.json")).collect()
    assert (row.uid, row.domain, row.place, row.person) == ("1", "lore", "Millford", None) and "(character)" in row.content


def test_stream_is_batch(spark, tmp_path):
    data = changes(spark, *[("a" if i % 2 else "b", f"k{i % 3}", str(i), i) for i in range(1, 11)]).drop("valid_until")
    for part in range(2):
        data.where(F.col("id") % 2 == part).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    store = ingest.Store(spark, f"file://{tmp_path}/store")
    for part in (0, 1, 1):  # the last comes twice
        stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / f"in/{part}"))
        ingest.start_state_stream(stream, store, str(tmp_path / f"cp{part}")).awaitTermination()
    run = ingest.state_batches(store)
    run(data.where("id % 2 = 1"), 9)
    out = store.read("world_state")
    assert out.count() == 10 and out.groupBy("id").count().where("count > 1").isEmpty()
    assert out.where("valid_until IS NULL").groupBy("chat_id", "key").count().where("count > 1").isEmpty()


def test_holding_back(spark):
    m = spark.createDataFrame([("a", i) for i in range(8)] + [("b", 0)], "chat_id string, message_index int")
    assert rows(ingest.settled(m), "chat_id", "message_index") == [("a", 0), ("a", 1), ("a", 2)]


def test_extraction(spark):
    from taleweave.streaming import extraction as E

    record = {
        "characters": [{"name": "Ann", "aliases": ["annie"], "significance": 2}, {"name": "Bo"}],
        "relationships": [{"from": "Ann", "to": "Bo", "sentiment": 0.4, "intensity": 0}],
        "events": [{"key": "e1", "summary": "They meet", "participants": ["Ann", "Bo"], "location": "Old Mill"}, {"key": "e2", "summary": "They part"}],
        "event_chains": [{"from": "e1", "to": "e2", "type": "causal"}, {"from": "e1", "to": "none"}],
        "world_state": [{"key": "Gate status", "value": "open"}],
        "knowledge_updates": [{"character": "Ann", "content": "Bo lies"}],
        "present": [{"character": "Ann", "location": "Old Mill"}],
        "plot_threads": [{"title": "The gate", "importance": 3}],
    }
    raw = spark.createDataFrame([("c", 4, T0, "Here:\n```json\n" + json.dumps(record) + "\n```"), ("c", 5, T0, "no json")], "chat_id string, message_index int, at timestamp_ntz, reply string")
    empty = {n: spark.createDataFrame([], s) for n, s in E.TABLES.items()}
    once = {n: spark.createDataFrame(df.collect(), df.schema) for n, df in E.apply(empty, E.parse(raw)).items()}
    want = {"characters": 2, "feels_about": 1, "events": 2, "participated_in": 2, "event_chains": 1, "world_state": 1, "facts": 1, "knows": 1, "items": 0, "present_at": 1, "plot_threads": 1}
    assert {n: once[n].count() for n in want} == want
    assert once["feels_about"].first()["intensity"] == 0.5 and once["world_state"].first()["key"] == "gate"
    twice = E.apply(once, E.parse(raw))
    assert {n: twice[n].count() for n in want if n != "present_at"} == {n: v for n, v in want.items() if n != "present_at"}
    assert twice["present_at"].where("is_current").count() == 1


def test_arcs_of_all_events(spark, monkeypatch):
    """Three hundred events of a chat, of which the last hundred resemble each other only: pairs against brute force, arcs beyond the 200th."""
    from taleweave.plans import catalog, registry

    r = np.random.default_rng(7)
    events = []
    for i in range(300):
        v = r.normal(size=4) * 0.1 + np.eye(4)[i // 100]
        events.append((f"e{i:03}", "c", i, f"loc-{i // 100}", i % 5, f"event {i}", [float(x) for x in v]))
    frame = spark.createDataFrame(events, "id string, chat_id string, message_index int, location_id string, significance int, summary string, embedding array<float>").withColumn("source_text", F.lit("x"))
    tables = {
        "story_events": frame.drop("embedding"),
        "event_vectors": frame.select("id", "embedding"),
        "participated": spark.createDataFrame([(f"p{i // 50}", f"e{i:03}") for i in range(300)], "character_id string, event_id string"),
        "chains": spark.createDataFrame([("e000", "e299"), ("e010", "e020")], "from_id string, to_id string"),
    }
    cos = lambda x, y: float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)))
    want = {}
    for i in range(300):
        for j in range(i + 1, 300):
            x, y = np.array(events[i][6], np.float32).astype(float), np.array(events[j][6], np.float32).astype(float)
            w = 0.5 * ((i, j) in ((0, 299), (10, 20))) + 0.6 * max(0, cos(x, y)) + 0.2 * 0.6 * (i // 50 == j // 50) + 0.4 * (i // 100 == j // 100) - (j - i) / 299
            if w >= 0.5:
                want[events[i][0], events[j][0]] = w
    monkeypatch.setattr(registry, "Tables", lambda *_: tables.__getitem__)
    ask = lambda name: catalog.QUERIES[name](spark, "")
    got = {(x["a"], x["b"]): x["w"] for x in ask("gr_event_graph").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert any(a > "e200" for a, _ in got)
    assert max(x["id"] for x in ask("gr_louvain").collect()) == "e299"
    assert max(x["event_id"] for x in ask("gr_rebuild").collect()) == "e299"


def test_pairs_across_blocks(spark, monkeypatch):
    """Small blocks and tiles, events without a place, a vector, people or length: the same pairs as a loop over all of them."""
    from taleweave.operators import arcs

    r = np.random.default_rng(3)
    events, people = [], {}
    for i in range(150):
        v = None if i % 29 == 5 else [0.0] * 4 if i % 31 == 7 else [float(x) for x in np.float32(r.normal(size=4) * 0.3 + np.eye(4)[i // 5 % 4])]
        events.append((f"e{i * 37 % 150:03}", "ab"[i % 7 == 0], i // 2, None if i % 11 == 0 else f"l{i % 3}", v))
        people[events[-1][0]] = {f"p{x}" for x in r.integers(0, 6, i % 4)}
    chains = [("e000", "e149"), ("e149", "e000"), ("e010", "e020"), ("e005", "e005"), ("e001", "gone")]
    linked = {frozenset(x) for x in chains}
    want = {}
    for x in events:
        for y in events:
            if x[1] != y[1] or (x[2], x[0]) >= (y[2], y[0]):
                continue
            span = max(e[2] for e in events if e[1] == x[1]) - min(e[2] for e in events if e[1] == x[1])
            m, n = (np.array(e[4] if e[4] else [0.0] * 4) for e in (x, y))
            cos = m @ n / (np.linalg.norm(m) * np.linalg.norm(n)) if m.any() and n.any() else 0.0
            p, q = people[x[0]], people[y[0]]
            w = 0.5 * (frozenset((x[0], y[0])) in linked) + 0.6 * max(0, cos) + 0.2 * max(0, (len(p & q) / len(p | q) if p and q else 0) - 0.4) + 0.4 * (x[3] is not None and x[3] == y[3]) - (y[2] - x[2]) / span
            if w >= 0.5:
                want[x[0], y[0]] = w
    frame = spark.createDataFrame(events, "id string, chat_id string, message_index int, location_id string, embedding array<float>")
    took = spark.createDataFrame([(p, e) for e, ps in people.items() for p in ps], "character_id string, event_id string")
    for name, value in {"BLOCK": 16, "TILE": 5, "PART": 3}.items():
        monkeypatch.setattr(arcs, name, value)
    found = arcs.pair_weights(frame, took, spark.createDataFrame(chains, "from_id string, to_id string")).collect()
    got = {(x["a"], x["b"]): x["w"] for x in found}
    assert len(found) == len(got) > 100 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    # a row stands in a few blocks, not in one for each block of its chat
    monkeypatch.undo()
    assert arcs.BLOCK >= 4096


def test_places_of_all_suppliers(spark, monkeypatch):
    """25,000 characters, all present: none loses its place."""
    from taleweave.plans import catalog, registry

    n, one = 25_000, spark.range(25_000)
    name = F.concat(F.lit("Name"), "id").alias("name")
    key = F.concat(F.lit("chr-s"), "id")
    tables = {
        "characters": one.select(key.alias("id"), name),
        "locations": spark.createDataFrame([("loc-1", "Here")], "id string, name string"),
        "present_at": one.select(key.alias("character_id"), F.lit("loc-1").alias("location_id"), F.lit("BUILDING").alias("chat_id"), F.lit(True).alias("is_current")),
        "snapshots": spark.createDataFrame([("x", "BUILDING", 0, "loc-1", "s", "calm")], "id string, chat_id string, message_index int, location_id string, summary string, tone string"),
        "snapshot_chars": one.select(F.lit("x").alias("snapshot_id"), name),
    }
    monkeypatch.setattr(registry, "Tables", lambda *_: tables.__getitem__)
    assert catalog.QUERIES["rd_locations"](spark, "").count() == n


def _records(seed, n=14):
    """Records of two chats that name the same few things again and again."""
    import json
    import random

    rng = random.Random(seed)
    some = lambda xs: rng.choice(xs)
    rows = []
    for i in range(n):
        rec = {
            "characters": [{"name": some(["Ann", "Bo", "Cy"]), "aliases": [some(["A", "B", " "])], "description": some(["", "tall", "old", None]), "role": some(["", "smith"]), "status": some([None, "alive"]), "significance": some([1, 5, None])} for _ in range(2)],
            "relationships": [{"from": some(["Ann", "Bo"]), "to": "Cy", "sentiment": rng.random(), "intensity": some([0, 0.4]), "description": some([None, "d"])}],
            "events": [{"key": "k1", "summary": some(["s1", "s2"]), "quote": some(["", "q"]), "participants": ["Ann", "Bo"], "location": some(["Inn", ""]), "significance": some([0, 4]), "world_time": some([" ", " noon "])}, {"key": "k2", "summary": "t", "participants": []}],
            "event_chains": [{"from": "k1", "to": "k2", "type": "causal"}],
            "world_state": [{"key": some(["Weather status", "gold", "battle"]), "value": str(i)}, {"key": "gold", "value": f"{i}b"}], "world_state_supersede": some([["gold"], ["weather"], []]),
            "knowledge_updates": [{"character": "Ann", "content": some(["f1", "f2"]), "domain": None}],
            "items": [{"name": "Sword", "owner": some(["Ann", "Bo", None]), "location": some(["Inn", None]), "status": some(["new", None])}],
            "locations_detail": [{"name": "Inn", "description": some(["", "warm", "cold"]), "importance": some([1, 3])}],
            "present": [{"character": some(["Ann", "Bo"]), "location": some(["Inn", "Port"])} for _ in range(2)],
            "plot_threads": some([[], [{"title": "quest", "thread_type": some(["a", "b"]), "importance": i}]]),
        }
        rows.append([f"c{i % 2}", 7 * i, rec, json.dumps(rec)])
    return rows


def test_one_batch_equals_many(spark):
    from taleweave.functions import text as X
    from taleweave.streaming import extraction as E

    ids = {c: spark.range(1).select(X.content_id("plot", F.lit(f"{c}|quest"))).first()[0] for c in ("c0", "c1")}
    rows = _records(4)
    for r in rows[3::3]:
        r[2]["resolves_thread_ids"] = [ids[r[0]]]
        r[3] = json.dumps(r[2])
    raw = spark.createDataFrame([(c, i, j) for c, i, _, j in rows], "chat_id string, message_index int, reply string").withColumn("at", F.timestamp_seconds(F.col("message_index") * 60).cast("timestamp_ntz"))
    empty = {n: spark.createDataFrame([], s) for n, s in E.TABLES.items()}

    def run(steps):
        tables = empty
        for low, high in steps:
            tables = {n: spark.createDataFrame(d.collect(), d.schema) for n, d in E.apply(tables, E.parse(raw.where(f"message_index BETWEEN {low} AND {high}"))).items()}
        return {n: sorted((tuple(r) for r in d.collect()), key=str) for n, d in tables.items()}

    whole = run([(0, 10_000)])
    for name, got in run([(0, 20), (21, 50), (51, 10_000)]).items():
        assert got == whole[name], name
    for name, got in run([(0, 10_000), (0, 10_000)]).items():
        if name != "world_state":
            assert got == whole[name], name


def test_failed_calls_are_returned(spark):
    from taleweave.streaming import extraction as E

    messages = spark.createDataFrame([("a", i, "n", f"m{i}") for i in range(30)], "chat_id string, message_index int, name string, mes string")

    def generate(prompt):
        if "m15" in prompt:
            raise ValueError("no")
        return "nothing" if "m25" in prompt else '{"events": [{"summary": "s"}]}'

    out = E.bulk({n: spark.createDataFrame([], s) for n, s in E.TABLES.items()}, messages, generate, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    assert out["events"].count() == 1 and {r.message_index for r in out["failed"].collect()} == {10, 20}
