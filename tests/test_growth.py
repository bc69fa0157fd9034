"""Work that must not grow faster than its input: parts, ranks and slices of small inputs against plain loops."""

import random

from pyspark.sql import functions as F

from taleweave.operators import similarity, state


def test_facts_over_parts(spark, monkeypatch):
    """Facts of many common trigrams, in parts of seven and products of three: as a loop over all pairs; facts of other domains are left out."""
    monkeypatch.setattr(similarity, "ROWS", 7)
    monkeypatch.setattr(similarity, "STEP", 3)
    rng = random.Random(4)
    words = ["sea", "storm", "ship", "crew", "harbour", "a", "night", "captain", "Straße", "x1"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    texts += [t[3:60] for t in texts[:10]] + [t[5:] + "!" for t in texts[10:20]]
    rows = [(f"f{i:02}", t, "lore" if i % 4 else "secret") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, content string, domain string")

    def grams(t):
        import re

        return {p[i : i + 3] for w in re.findall("[a-z0-9]+", t.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)}

    def best(n):
        found = []
        for k in rows:
            if k[2] == n[2] and k[0] != n[0]:
                x, y, a, b = grams(n[1]), grams(k[1]), n[1].lower(), k[1].lower()
                like = round(len(x & y) / len(x | y), 9)
                if like > 0.45 or a in b or b in a:
                    found.append((-len(b), -like, k[0]))
        return min(found)[2] if found else None

    got = {r.new_id: r.id for r in state.match_facts(df.where("domain = 'lore'"), df).collect()}
    assert got == {r[0]: best(r) for r in rows if r[2] == "lore"}
    sides = [df.select("id", F.lit("b").alias("block"), F.lower("content").alias("text"))] * 2
    assert sorted(map(tuple, similarity.contained_pairs(*sides).collect())) == sorted((a[0], b[0]) for a in rows for b in rows if b[1].lower() in a[1].lower())


def test_places_in_a_chat(spark):
    """Numbers over stretches equal one row_number over the chat, negative ids and null keys included; no window holds a whole chat."""
    from taleweave.sources import fixtures

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-200_000, 900_000, 7919)])) for _ in range(500)]
    df = spark.createDataFrame(list(set(rows)), "chat_id string, id long")
    got = fixtures.numbered(df, ["id"], "id div 65536").withColumn("want", F.expr("cast(row_number() over (partition by chat_id order by id) - 1 as int)"))
    assert got.count() == df.count() and got.where("message_index <> want").count() == 0
    t = fixtures.Tables(spark, "/root/testdata/sf0.001")
    for name in ("story_events", "memory"):
        one = t.sql(fixtures.ADAPTERS[name])
        assert t(name).columns == one.columns and t(name).exceptAll(one).count() == 0 and t(name).count() == one.count()
        assert "windowspecdefinition(c_mktsegment" not in (plan := t(name)._jdf.queryExecution().optimizedPlan().toString()) and "windowspecdefinition(chat_id" in plan and ", _s" in plan


def test_few_names_meet_texts_where_they_are_read(spark, monkeypatch):
    """The same pairs with names sent to the texts and with a shuffle of words; the first has no join by text."""
    from taleweave.operators import naming

    texts = spark.createDataFrame([(i, f"Ann and Bo {i} met old-tom") for i in range(20)] + [(1, "Bo"), (30, None)], "id int, text string")
    names = spark.createDataFrame([("n1", "ann"), ("n2", "Old-Tom"), ("n3", "Bo 1"), ("n4", "nobody")], "name_id string, name string")
    few = naming.mentioned_in(texts, names)
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 0)
    assert want == sorted(map(tuple, naming.mentioned_in(texts, names).collect())) and len(want) == 41


def test_texts_in_slices(spark, monkeypatch):
    """A batch is cut by bytes, whole texts each, and the order of rows stays."""
    import pyarrow as pa

    from taleweave.functions import english
    from taleweave.operators import postings

    monkeypatch.setattr(english, "SLICE", 10)
    cut = [x.to_pylist() for x in english.slices(iter([pa.array(["aaaa", None, "bbbb", "cccc", "d" * 40, "", "e"]), pa.array([], pa.string())]))]
    assert cut == [["aaaa", None, "bbbb"], ["cccc"], ["d" * 40], ["", "e"], []]
    df = spark.createDataFrame([(i, None if i == 5 else f"word{i} running " * (i % 4)) for i in range(50)], "id int, text string").coalesce(1)
    found = df.select("id", "text", postings.vector_text(postings.postings("text")).alias("v"), english.headline("text", ["run"]).alias("h")).collect()
    assert all((r.v == "") == (not r.text) and (f"'word{r.id}'" in r.v) == bool(r.text) and (f"word{r.id} <b>running</b>" in r.h) == bool(r.text) for r in found)


def test_replies_are_parsed_once(spark):
    """The same records as with all forms of every reply parsed; a form is parsed in one place of the plan, and presence reads kept records."""
    from taleweave.functions import text as X
    from taleweave.plans import catalog
    from taleweave.streaming import extraction

    replies = ['{"present": [{"character": "A"}]}', 'Sure: ```json\n{"present": [{"character": "B"},]}\n``` {', "so {\"present\": []} it is", "{broken", "none", "", None, ' ﻿{"present": null} // x\n', "[1]", '```{"a": 1}``` {"present": [{"character": "C"}]}']
    raw = spark.createDataFrame([("c", i, r) for i, r in enumerate(replies)], "chat_id string, message_index int, reply string").withColumn("at", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    forms = F.transform(X.json_candidates("reply"), lambda c: F.when(c.rlike(r"^\s*\{"), F.from_json(c, extraction.RECORD)))
    want = raw.select("chat_id", "message_index", "at", F.get(F.filter(forms, lambda x: x.isNotNull()), F.lit(0)).alias("r")).where("r IS NOT NULL").select("chat_id", "message_index", "at", "r.*")
    got = extraction.parse(raw)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan(got).count("from_json") == 3
    assert "from_json" not in plan(catalog.QUERIES["up_extraction_presence"](spark, "/root/testdata/sf0.001"))


def test_a_retrieval_derives_its_events_once(spark):
    """Tables of some chats give those chats' rows, and what is derived from them starts at the kept copy; mentioned characters are told apart before what they took part in."""
    from taleweave.operators import search
    from taleweave.plans import retrieve
    from taleweave.sources import fixtures

    t, chats = fixtures.Tables(spark, "/root/testdata/sf0.001"), ["BUILDING", "src:src1"]
    own = retrieve.scoped(t, chats)
    for name in ("story_events", "memory", "event_vectors", "plot_threads"):
        want = t(name).where(F.col("chat_id").isin(chats)).drop("embedding")
        assert own(name).drop("embedding").exceptAll(want).count() == 0 and own(name).count() == want.count() > 0
    plan = own("event_vectors")._jdf.queryExecution().optimizedPlan().toString()
    assert "c_mktsegment" not in plan and "l_orderkey" not in plan
    names = spark.createDataFrame([("x", "Ann", "annie"), ("y", "Bo", "bobby"), ("z", "Cid", "cid")], "id string, name string, alias string")
    took = spark.createDataFrame([("x", "e1"), ("x", "e2"), ("y", "e1"), ("z", "e3")], "character_id string, event_id string")
    events = spark.createDataFrame([("e1", "c"), ("e2", "c"), ("e3", "d")], "id string, chat_id string")
    assert sorted(map(tuple, search.mentioned(names, took, events, ["c"], "Annie, bobby and Cid").collect())) == [("x", "Ann"), ("y", "Bo")]


def test_every_trait_has_neighbours(spark):
    """jn_knn asks for each trait, not for some ids only: as many rows as the least of three and the others of its character and category."""
    from taleweave.plans import catalog
    from taleweave.sources import fixtures

    folder = "/root/testdata/sf0.001"
    t = fixtures.Tables(spark, folder)("traits")
    want = t.join(t.groupBy("character_id", "category").count(), ["character_id", "category"]).selectExpr("id", "least(3, count - 1) AS n").where("n > 0")
    got = catalog.QUERIES["jn_knn"](spark, folder).groupBy("a_id").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("a_id % 50 <> 0").count() > 0


def test_pairs_are_summed_where_they_are_found(spark, monkeypatch):
    """Sums by chat and by shared label equal those of the pairs, with and without a table of vectors and of near ones; no vector is shuffled."""
    import numpy as np

    from taleweave.operators import arcs

    r = np.random.default_rng(11)
    some = [[float(x) for x in np.float32(r.normal(size=6))] for _ in range(20)]
    events = [(f"e{i}", "ab"[i % 5 == 0], i, f"l{i % 4}" if i % 9 else None, None if i % 17 == 3 else some[int(r.integers(20))]) for i in range(400)]
    frame = spark.createDataFrame(events, "id string, chat_id string, message_index int, location_id string, embedding array<float>")
    took = spark.createDataFrame([(f"p{k}", e[0]) for e in events for k in set(r.integers(0, 9, 3).tolist())], "character_id string, event_id string")
    chains = spark.createDataFrame([(f"e{i}", f"e{i + 5}") for i in range(0, 300, 7)], "from_id string, to_id string")
    labels = spark.createDataFrame([(e[0], f"c{k}") for n, e in enumerate(events) for k in {n // 50, n % 3} if n % 4], "id string, label string")
    of = (frame.drop("embedding"), took, chains)
    found = []
    for change in ({}, {"NEAR": -1}, {"TABLE": -1}, {"BLOCK": 256, "TILE": 16, "PICKED": 50}):
        with monkeypatch.context() as m:
            for name, value in change.items():
                m.setattr(arcs, name, value)
            pairs = arcs.pair_weights(*of, vectors=frame.select("id", "embedding"))
            sums = arcs.pair_sums(*of, vectors=frame.select("id", "embedding"), labels=labels)
            if not change:
                assert "embedding" not in sums._jdf.queryExecution().executedPlan().toString()
            found.append((sorted((x.chat_id, x.a, x.b, round(x.w, 8)) for x in pairs.collect()) if "NEAR" not in change else found[0][0], {(x.chat_id, x.label): x for x in sums.collect()}))
    of_event = {}
    for x in labels.collect():
        of_event.setdefault(x.id, set()).add(x.label)
    want = {}
    for chat, a, b, w in found[0][0]:
        for label in {None} | (of_event.get(a, set()) & of_event.get(b, set())):
            want.setdefault((chat, label), []).append(w)
    assert len(found[0][0]) > 500 and len(want) > 10
    for pairs, sums in found:
        assert pairs == found[0][0] and sums.keys() == want.keys()
        assert all(s.n == len(want[k]) and abs(s.total - sum(want[k])) < 1e-5 and abs(s.most - max(want[k])) < 1e-7 and abs(s.least - min(want[k])) < 1e-7 for k, s in sums.items())


def test_communities_by_numbers(spark):
    """Pairs by places in the chat give the same communities as pairs by ids; a vertex of many neighbours is summed like one of few."""
    import numpy as np

    from taleweave.operators import arcs

    r = np.random.default_rng(2)
    n = 90
    ids = [f"e{i:02}" for i in range(n)]
    pairs = [("c", i, j, float(np.round(r.uniform(0.5, 1.0), 9))) for i in range(n) for j in range(i + 1, n) if r.random() < (0.5 if i // 30 == j // 30 else 0.02)]
    events = spark.createDataFrame([("c", x, i // 2) for i, x in enumerate(ids)], "chat_id string, id string, message_index int")
    numbers = spark.createDataFrame(pairs, "chat_id string, a int, b int, w double")
    named = spark.createDataFrame([(c, ids[a], ids[b], w) for c, a, b, w in pairs], "chat_id string, a string, b string, w double")
    got = [sorted(map(tuple, arcs.communities(events, w, 1.0).collect())) for w in (numbers, named)]
    assert got[0] == got[1] and len(got[0]) == n and [x[2] for x in got[0]] == [i // 30 for i in range(n)]
    a, b, w = (np.array(x) for x in list(zip(*pairs))[1:])
    few, arcs.FEW = arcs.FEW, 0
    try:
        assert (np.unique(arcs.louvain(a, b, w, n, 1.0), return_inverse=True)[1] == np.arange(n) // 30).all()
    finally:
        arcs.FEW = few


def test_events_without_texts_read_no_brands(spark):
    """What is derived from events without their texts joins no parts, with the same rows; edges are found once for all steps of an expansion."""
    from taleweave.operators import graph
    from taleweave.plans import catalog
    from taleweave.sources import fixtures

    folder = "/root/testdata/sf0.001"
    t = fixtures.Tables(spark, folder)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    bare = t.lean("story_events")
    assert "p_brand" in plan(t("story_events")) and "source_text" in t("story_events").columns and t.sql("SELECT * FROM story_events").columns == t("story_events").columns
    assert bare.columns == [c for c in t("story_events").columns if c != "source_text"]
    assert bare.exceptAll(t("story_events").drop("source_text")).count() == 0 and bare.count() == t("story_events").count()
    for name in ("present_at", "chains", "arc_events", "event_vectors", "plot_threads"):
        assert "p_brand" not in plan(t(name)) and "p_partkey" not in plan(t(name)), name
    assert "p_partkey" not in plan(catalog.QUERIES["jn_compound"](spark, folder)) and "p_partkey" not in plan(graph.edges(t, ["BUILDING"]).where("edge <> 'owns' AND edge <> 'lies_at'"))
    given = t.keeping(story_events=t("story_events").limit(3))
    assert given.lean("story_events").count() == 3 and "source_text" not in given.lean("story_events").columns
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pairs = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)], "src string, dst string").withColumns({"src_type": F.lit("t"), "dst_type": F.lit("t")})
    found = graph.expand(pairs.mapInArrow(count, pairs.schema), spark.createDataFrame([("n0", "t")], "id string, type string"), 3)
    assert sorted((x.id, x.hop) for x in found.collect()) == [(f"n{i}", i) for i in range(4)] and seen.value == 8


def test_traits_meet_canonical_rows_ahead(spark, monkeypatch):
    """A row's canonical rows are found by products made ahead of it: the same rows as a loop that weighs each pair, whatever the product's size."""
    import numpy as np

    from taleweave.operators import traits

    assert traits.AHEAD > 1
    r = np.random.default_rng(9)
    some = r.normal(size=(25, 5))
    data = [("a", "p", i, f"trait {i:03} of {'x' * (i % 7)}", None if i % 13 == 4 else [float(x) for x in some[int(r.integers(25))] + r.normal(size=5) * 0.2]) for i in range(200)]
    df = spark.createDataFrame(data, "character_id string, category string, id long, content string, embedding array<double>")
    kept, want = [], []
    for row in sorted(data, key=lambda x: (-len(x[3]), x[2])):
        v, best = row[4], None
        if v:
            best = max(((float(np.dot(v, u) / (np.linalg.norm(v) * np.linalg.norm(u))), -i, i) for i, u in kept), default=None)
        hit = best and best[0] >= 0.88
        if not hit and v:
            kept.append((row[2], v))
        want.append((row[2], best[2] if hit else None))
    for ahead in (traits.AHEAD, 16):
        monkeypatch.setattr(traits, "AHEAD", ahead)
        got = traits.fold(df, 0.88, 0.88, True).collect()
        assert sorted((x.id, x.canonical_id) for x in got) == sorted(want) and sum(x.canonical_id is not None for x in got) > 50
