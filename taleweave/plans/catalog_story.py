"""Graph, arcs, state, identity, streams and evaluation, with the SQL that checks them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import relevance as R
from ..functions import text as X
from ..functions import vector as V
from ..operators import arcs, evaluation, graph, identity, models, reads, state, traits
from ..sources.fixtures import lean
from ..streaming import extraction, ingest
from ..session import durable, stored
from .catalog_functions import TOKENS, TRIGRAMS
from .registry import query

# graph
_E = """edges AS (
    SELECT from_id AS src, 'character' AS st, to_id AS dst, 'character' AS dt, 'feels_about' AS edge FROM feels WHERE session_id = 'BUILDING' UNION ALL SELECT to_id, 'character', from_id, 'character', 'feels_about' FROM feels WHERE session_id = 'BUILDING'
    UNION ALL SELECT p.character_id, 'character', p.event_id, 'event', 'participated_in' FROM participated p JOIN story_events e ON e.id = p.event_id AND e.chat_id = 'BUILDING' UNION ALL SELECT p.event_id, 'event', p.character_id, 'character', 'participated_in' FROM participated p JOIN story_events e ON e.id = p.event_id AND e.chat_id = 'BUILDING'
    UNION ALL SELECT a.arc_id, 'story_arc', a.event_id, 'event', 'arc_events' FROM arc_events a JOIN story_events e ON e.id = a.event_id AND e.chat_id = 'BUILDING' UNION ALL SELECT a.event_id, 'event', a.arc_id, 'story_arc', 'arc_events' FROM arc_events a JOIN story_events e ON e.id = a.event_id AND e.chat_id = 'BUILDING'
    UNION ALL SELECT character_id, 'character', fact_id, 'fact', 'knows' FROM knows WHERE chat_id IN ('BUILDING', 'fr') UNION ALL SELECT id, 'event', location_id, 'location', 'at' FROM story_events WHERE chat_id = 'BUILDING'
    UNION ALL SELECT owner_id, 'character', id, 'item', 'owns' FROM items WHERE chat_id = 'BUILDING' UNION ALL SELECT id, 'item', location_id, 'location', 'lies_at' FROM items WHERE chat_id = 'BUILDING'
    UNION ALL SELECT c.from_id, 'event', c.to_id, 'event', 'chain' FROM chains c JOIN story_events e ON e.id = c.from_id AND e.chat_id = 'BUILDING'
    UNION ALL SELECT c.character_id, 'character', c.plot_id, 'plot_thread', 'plot' FROM plot_characters c JOIN plot_threads p ON p.id = c.plot_id AND p.chat_id = 'BUILDING')"""
_edges = lambda t: graph.edges(t, ["BUILDING", "fr"])
_seed = lambda t: t("characters").where("id = 'chr-s7'").select("id", F.lit("character").alias("type"))
_REACH = """reach AS (SELECT 'chr-s7' AS id, 'character' AS type, 0 AS hop UNION SELECT e.dst, e.dt, r.hop + 1 FROM reach r JOIN edges e ON e.src = r.id AND e.st = r.type WHERE r.hop < {0})"""
query("gr_edges", f"WITH {_E} SELECT edge, src, st AS src_type, dst, dt AS dst_type FROM edges")(_edges)
query("so_union_all_edges", f"WITH {_E} SELECT edge, count(*) AS n FROM edges GROUP BY edge")(lambda t: _edges(t).groupBy("edge").agg(F.count("*").alias("n")))
query("gr_traverse", f"WITH RECURSIVE {_E}, {_REACH.format(3)} SELECT id, type, min(hop) AS hop FROM reach GROUP BY id, type")(lambda t: graph.expand(_edges(t), _seed(t), 3, stored))
query("so_rec_union", f"WITH RECURSIVE {_E}, {_REACH.format(2)} SELECT id, type, min(hop) AS hop FROM reach GROUP BY id, type")(lambda t: graph.expand(_edges(t), _seed(t), 2))
query("gr_induced", f"WITH RECURSIVE {_E}, {_REACH.format(1)}, n AS (SELECT DISTINCT id, type FROM reach) SELECT e.edge, e.src, e.dst FROM edges e JOIN n a ON a.id = e.src AND a.type = e.st JOIN n b ON b.id = e.dst AND b.type = e.dt")(
    lambda t: graph.induced(_edges(t), graph.expand(_edges(t), _seed(t), 1)).select("edge", "src", "dst")
)
query("gr_chats_of_char", "SELECT DISTINCT e.chat_id FROM characters c JOIN participated p ON p.character_id = c.id JOIN story_events e ON e.id = p.event_id WHERE c.alias = 'supplier#000000007'")(lambda t: graph.chats_of(t("characters"), t("participated"), t("story_events"), "Supplier#000000007"))
query("gr_global", f"WITH {_E} SELECT src AS id, st AS type FROM edges WHERE edge <> 'knows' UNION SELECT dst, dt FROM edges WHERE edge <> 'knows'")(lambda t: graph.touched(_edges(t)))
query("gr_edge_dto", f"""WITH {_E} SELECT DISTINCT CASE edge WHEN 'feels_about' THEN 'fa' WHEN 'knows' THEN 'kn' WHEN 'participated_in' THEN 'pi' WHEN 'at' THEN 'at' WHEN 'owns' THEN 'own' WHEN 'arc_events' THEN 'ae' WHEN 'plot' THEN 'pt' ELSE 'ch' END || '-' || src || '-' || dst AS edge_id,
    CASE edge WHEN 'knows' THEN 0.3 WHEN 'participated_in' THEN 0.5 WHEN 'at' THEN 0.4 WHEN 'plot' THEN 0.4 WHEN 'owns' THEN 0.5 WHEN 'arc_events' THEN 0.7 WHEN 'chain' THEN 0.7 ELSE 0.5 END::DOUBLE AS intensity FROM edges WHERE edge <> 'lies_at' AND NOT (edge IN ('participated_in', 'arc_events') AND st = 'event')""")(
    lambda t: graph.edge_rows(_edges(t)).select("edge_id", "intensity")
)
_N2 = "both_ways AS (SELECT from_id AS a, to_id AS b FROM feels UNION SELECT to_id, from_id FROM feels)"
query("gr_neighborhood", f"WITH RECURSIVE {_N2}, n AS (SELECT 'chr-c7' AS id, 0 AS hop UNION SELECT b, hop + 1 FROM n JOIN both_ways ON a = id WHERE hop < 2) SELECT id, min(hop) AS hop FROM n GROUP BY id")(
    lambda t: graph.neighbourhood(t("feels").select(F.col("from_id").alias("a"), F.col("to_id").alias("b")), t("characters").where("id = 'chr-c7'").select("id"), 2)
)
query("gr_degree", f"WITH {_E} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) x GROUP BY id")(lambda t: graph.degrees(_edges(t).select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"))))

# arcs, over all events of each chat
_EVERY = "every_event AS (SELECT s.*, v.embedding FROM story_events s JOIN event_vectors v ON v.id = s.id)"
#: Pairs are met by their distance in time, which a shared place stretches, then by what the vectors can still bring, and then weighed; linked events always.
_PAIRS = f"""{_EVERY}, ppl AS (SELECT event_id, list(DISTINCT character_id) AS p FROM participated GROUP BY event_id), span AS (SELECT chat_id, greatest(max(message_index) - min(message_index), 1) AS s FROM every_event GROUP BY chat_id),
    link AS (SELECT DISTINCT least(from_id, to_id) AS lo, greatest(from_id, to_id) AS hi FROM chains),
    ev AS MATERIALIZED (SELECT e.chat_id, e.id, e.message_index, e.location_id, CAST(e.embedding AS DOUBLE[]) AS v, s.s FROM every_event e JOIN span s ON s.chat_id = e.chat_id),
    near AS (SELECT a.id AS a, b.id AS b FROM ev a JOIN ev b ON b.chat_id = a.chat_id AND (a.message_index, a.id) < (b.message_index, b.id) AND b.message_index <= a.message_index + ceil(0.62 * a.s) + 1
      AND abs(a.message_index - b.message_index) / a.s::DOUBLE <= 0.220001 + CASE WHEN a.location_id = b.location_id THEN 0.4 ELSE 0 END
      WHERE 0.6 * greatest(0, list_cosine_similarity(a.v, b.v)) + 0.120001 + CASE WHEN a.location_id = b.location_id THEN 0.4 ELSE 0 END - abs(a.message_index - b.message_index) / a.s::DOUBLE >= 0.5),
    met AS (SELECT a, b FROM near UNION SELECT a.id, b.id FROM link l JOIN ev x ON x.id = l.lo JOIN ev y ON y.id = l.hi AND y.chat_id = x.chat_id JOIN ev a ON a.id = CASE WHEN (x.message_index, x.id) < (y.message_index, y.id) THEN x.id ELSE y.id END JOIN ev b ON b.id = CASE WHEN a.id = x.id THEN y.id ELSE x.id END AND (a.message_index, a.id) < (b.message_index, b.id)),
    w AS (SELECT a.chat_id, a.id AS a, b.id AS b, round(0.5::DOUBLE * (CASE WHEN l.lo IS NULL THEN 0 ELSE 1 END) + 0.6::DOUBLE * greatest(0, list_cosine_similarity(a.v, b.v))
      + 0.2::DOUBLE * greatest(0, CASE WHEN len(coalesce(p.p, [])) > 0 AND len(coalesce(q.p, [])) > 0 THEN len(list_intersect(p.p, q.p)) / len(list_distinct(list_concat(p.p, q.p)))::DOUBLE ELSE 0 END - 0.4)
      + 0.4::DOUBLE * (CASE WHEN a.location_id = b.location_id THEN 1 ELSE 0 END) - abs(a.message_index - b.message_index) / a.s::DOUBLE, 9) AS w
      FROM met JOIN ev a ON a.id = met.a JOIN ev b ON b.id = met.b
      LEFT JOIN ppl p ON p.event_id = a.id LEFT JOIN ppl q ON q.event_id = b.id LEFT JOIN link l ON l.lo = least(a.id, b.id) AND l.hi = greatest(a.id, b.id)),
    kept AS (SELECT * FROM w WHERE w >= 0.5)"""
_every = lambda t: lean(t, "story_events").join(t("event_vectors").select("id", "embedding"), "id")
_of = lambda t: (lean(t, "story_events").select("id", "chat_id", "message_index", "location_id"), t("participated"), t("chains"))
_vectors = lambda t: t("event_vectors").select("id", "embedding")
_weights = lambda t: arcs.pair_weights(*_of(t), vectors=_vectors(t))
_sums = lambda t, **more: arcs.pair_sums(*_of(t), vectors=_vectors(t), **more)
query("gr_event_graph", f"WITH {_PAIRS} SELECT chat_id, a, b, CAST(round(w * 1000000000) AS BIGINT) AS w FROM kept")(lambda t: _weights(t).withColumn("w", F.round(F.col("w") * 1_000_000_000).cast("long")))
query("jn_pairs", f"WITH {_PAIRS} SELECT chat_id, count(*) AS n, round(sum(w), 4) AS total FROM kept GROUP BY chat_id")(lambda t: _sums(t).select("chat_id", "n", F.round("total", 4).alias("total")))
query("fn_edge_w", f"WITH {_PAIRS} SELECT chat_id, round(max(w), 6) AS most, round(min(w), 6) AS least FROM kept GROUP BY chat_id")(lambda t: _sums(t).select("chat_id", F.round("most", 6).alias("most"), F.round("least", 6).alias("least")))
query("gr_dryrun", f"WITH {_PAIRS}, n AS (SELECT chat_id, count(*) AS n FROM every_event GROUP BY chat_id), e AS (SELECT chat_id, count(*) AS m FROM kept GROUP BY chat_id) SELECT n.chat_id, n.n AS events, coalesce(m, 0) AS edges, round(2 * coalesce(m, 0) / n::DOUBLE, 6) AS degree FROM n LEFT JOIN e ON e.chat_id = n.chat_id")(
    lambda t: _every(t).groupBy("chat_id").agg(F.count("*").alias("events")).join(_sums(t).select("chat_id", F.col("n").alias("edges")), "chat_id", "left").na.fill(0).withColumn("degree", F.round(2 * F.col("edges") / F.col("events"), 6))
)
query("fn_density", f"""WITH {_PAIRS}, m AS (SELECT f.chat_id, f.id, a.arc_id AS c FROM every_event f JOIN arc_events a ON a.event_id = f.id), n AS (SELECT chat_id, count(*) AS n FROM m GROUP BY chat_id), e AS (SELECT chat_id, count(*) AS m FROM kept GROUP BY chat_id),
    k AS (SELECT chat_id, c, count(*) AS k FROM m GROUP BY chat_id, c), i AS (SELECT x.c, count(*) AS i FROM kept t JOIN m x ON x.id = t.a JOIN m y ON y.id = t.b AND y.c = x.c GROUP BY x.c)
    SELECT k.c AS community, CASE WHEN coalesce(e.m, 0) * (k * (k - 1) / 2.0) / greatest(1, n * (n - 1) / 2.0) > 0 THEN round(coalesce(i, 0) / (e.m * (k * (k - 1) / 2.0) / greatest(1, n * (n - 1) / 2.0)), 6) ELSE 0 END AS density
    FROM k JOIN n ON n.chat_id = k.chat_id LEFT JOIN e ON e.chat_id = k.chat_id LEFT JOIN i ON i.c = k.c""")(
    lambda t: arcs.density_of(_every(t).select("chat_id", "id").join(t("arc_events").select(F.col("event_id").alias("id"), F.col("arc_id").alias("community")), "id"), stored(_sums(t, labels=t("arc_events").select(F.col("event_id").alias("id"), F.col("arc_id").alias("label"))))).select("community", F.round("density", 6).alias("density"))
)
query("gr_louvain")(lambda t: arcs.communities(_every(t), arcs.pair_weights(*_of(t), vectors=_vectors(t), numbers=True)))
query("gr_hier")(lambda t: arcs.rebuild(stored(_every(t).drop("embedding")), t("participated"), t("chains"), durable, _vectors(t))[0].select("id", "chat_id", "hierarchy_level", "spine", "size", "parent_arc_id"))
query("gr_rebuild")(lambda t: arcs.rebuild(stored(_every(t).drop("embedding")), t("participated"), t("chains"), durable, _vectors(t))[1])
query("gr_spine", "SELECT arc_id, id FROM (SELECT a.arc_id, e.id, row_number() OVER (PARTITION BY a.arc_id ORDER BY e.significance DESC, e.message_index, e.id) AS r FROM arc_events a JOIN story_events e ON e.id = a.event_id) x WHERE r = 1")(
    lambda t: arcs.describe(t("arc_events").select(F.col("arc_id").alias("community"), F.col("event_id").alias("id")).join(t("story_events"), "id")).select(F.col("community").alias("arc_id"), F.col("spine").alias("id"))
)
query("gr_parent", "SELECT child, parent FROM (SELECT a.arc_id AS child, s.parent_arc_id AS parent, row_number() OVER (PARTITION BY a.arc_id ORDER BY count(*) DESC, s.parent_arc_id) AS r FROM arc_events a JOIN story_arcs s ON s.id = a.arc_id GROUP BY a.arc_id, s.parent_arc_id) x WHERE r = 1")(
    lambda t: arcs.parents(t("arc_events").select(F.col("arc_id").alias("child"), "event_id"), t("arc_events").join(t("story_arcs").where("hierarchy_level = 1").select(F.col("id").alias("arc_id"), F.col("parent_arc_id").alias("parent")), "arc_id").select("parent", "event_id")).select("child", "parent")
)
_NEW = "SELECT id, hierarchy_level, concat('evt-', start_idx) AS spine, concat('Arc: ', id) AS title FROM story_arcs"
query("gr_recycle", f"SELECT n.id, coalesce(o.title, n.title) AS title, o.title IS NOT NULL AS recycled FROM ({_NEW}) n LEFT JOIN (SELECT hierarchy_level, concat('evt-', start_idx) AS spine, min(concat('The tale of ', start_idx)) AS title FROM story_arcs WHERE start_idx % 3 = 0 GROUP BY ALL) o ON o.hierarchy_level = n.hierarchy_level AND o.spine = n.spine")(
    lambda t: arcs.recycled(
        t("story_arcs").select("id", "hierarchy_level", F.concat(F.lit("evt-"), "start_idx").alias("spine"), F.concat(F.lit("Arc: "), "id").alias("title")),
        t("story_arcs").select("hierarchy_level", F.concat(F.lit("evt-"), "start_idx").alias("spine"), F.when(F.col("start_idx") % 3 == 0, F.concat(F.lit("The tale of "), "start_idx")).otherwise(F.concat(F.lit("Arc: "), "id")).alias("title")),
    ).select("id", "title", "recycled")
)
query("gr_name_gate", "SELECT id FROM story_arcs WHERE importance >= 4 AND start_idx % 3 <> 0")(lambda t: arcs.to_name(t("story_arcs").select("id", F.when(F.col("importance") >= 4, 2.0).otherwise(1.0).alias("density"), (F.col("start_idx") % 3 == 0).alias("recycled"))).select("id"))

# state and merges
_CUT = "TIMESTAMP '2024-01-15 00:00:00'"
query("up_world_state", "SELECT chat_id, key, value, valid_from, lead(valid_from) OVER (PARTITION BY chat_id, key ORDER BY valid_from, source_message_index) AS valid_until FROM state_stream")(
    lambda t: state.apply_changes(
        state.versions(t("state_stream").where("source_message_index <= 30").withColumnRenamed("event_id", "id"), ["chat_id", "key"], ["valid_from", "source_message_index"]).select("id", "chat_id", "key", "value", "valid_from", "valid_until", "source_message_index"),
        t("state_stream").where("source_message_index > 30").withColumnRenamed("event_id", "id"),
    ).select("chat_id", "key", "value", "valid_from", "valid_until")
)
query("up_ws_supersede", f"SELECT id, CASE WHEN valid_until IS NULL AND chat_id = 'u7' AND key IN ('click', 'view') THEN {_CUT} ELSE valid_until END AS valid_until FROM world_state")(
    lambda t: state.supersede(t("world_state"), "u7", ["Click", "view status"], F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("id", "valid_until")
)
query("up_ws_ttl", f"SELECT id, CASE WHEN valid_until IS NULL AND event_id % 2 = 0 AND 100 - source_message_index > 12 THEN {_CUT} ELSE valid_until END AS valid_until FROM (SELECT *, id AS event_id FROM world_state) x")(
    lambda t: state.expire(t("world_state").withColumn("key", F.when(F.col("id") % 2 == 0, F.concat(F.lit("ship "), "key")).otherwise(F.col("key"))), F.lit(100), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("id", "valid_until")
)
query("st_ttl", f"SELECT count(*) AS closed FROM world_state WHERE valid_until IS NULL AND 100 - source_message_index > 12")(
    lambda t: state.expire(t("world_state").where("valid_until IS NULL").withColumn("key", F.concat(F.lit("weather "), "key")), F.lit(100), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).agg(F.count_if(F.col("valid_until").isNotNull()).alias("closed"))
)
query("up_ws_cleanup", f"""SELECT id, CASE WHEN valid_until IS NOT NULL THEN valid_until WHEN r > 1 THEN {_CUT} END AS valid_until FROM (SELECT id, until AS valid_until, CASE WHEN until IS NULL THEN row_number() OVER (PARTITION BY chat_id, key ORDER BY valid_from DESC, id DESC) END AS r
    FROM (SELECT *, CASE WHEN id % 3 = 0 THEN NULL ELSE valid_until END AS until FROM world_state) x) y""")(
    lambda t: state.clean(t("world_state").withColumn("valid_until", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("valid_until"))), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("id", "valid_until")
)
_old = lambda t: t("items").where("significance <> 2")
_new = lambda t: t("items").where("significance <= 3").withColumn("name", F.when(F.col("significance") == 1, F.lit("")).otherwise(F.upper("name")))
query("up_item", "SELECT id, CASE significance WHEN 2 THEN upper(name) ELSE name END AS name, owner_id, CASE WHEN significance = 1 THEN 4 ELSE significance END AS significance FROM items")(
    lambda t: state.merge(_old(t), _new(t).withColumn("significance", F.when(F.col("significance") == 1, 4).otherwise(F.col("significance"))), ["id"], state.ITEM_RULES).select("id", "name", "owner_id", "significance")
)
query("up_character", """SELECT CASE WHEN c_custkey % 2 = 0 THEN 'chr-c' || c_custkey ELSE 'chr-' || regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') END AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) END AS name,
    array_to_string(list_sort([upper(c_name), lower(c_name), 'x-' || c_custkey]), '|') AS aliases, CASE WHEN c_custkey % 4 = 0 THEN 'old' WHEN c_custkey % 4 = 2 THEN 'new' ELSE CASE WHEN c_custkey % 4 = 1 THEN 'new' ELSE '' END END AS description FROM customer""")(
    lambda t: identity.upsert(
        t("customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("chr-c"), "c_custkey").alias("id"), F.lit(None).cast("string").alias("chat_id"), F.col("c_name").alias("name"), F.array(F.lower("c_name")).alias("aliases"), F.lit("old").alias("description")),
        t("customer").select(F.lit(None).cast("string").alias("chat_id"), F.upper("c_name").alias("name"), F.array(F.lower("c_name"), F.concat(F.lit("x-"), "c_custkey"), F.lit(" ")).alias("aliases"), F.when(F.col("c_custkey") % 4 == 0, "").when(F.col("c_custkey") % 4 == 3, "").otherwise("new").alias("description")),
    ).select("id", "name", F.array_join("aliases", "|").alias("aliases"), "description")
)
query("up_persona", "SELECT concat('persona-', regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g')) AS id, name FROM characters WHERE id = 'chr-c7'")(lambda t: t("characters").where("id = 'chr-c7'").select(F.concat(F.lit("persona-"), F.regexp_replace(X.slug("name"), "^chr-", "")).alias("id"), "name"))
query("up_char_attr", "SELECT id, greatest(significance, 3) AS significance, CASE WHEN significance > 2 THEN 'guard' ELSE 'smith' END AS role, CASE WHEN significance > 2 THEN 'hurt' ELSE 'well' END AS status FROM characters")(
    lambda t: state.merge(
        t("characters").withColumns({"role": F.lit("smith"), "status": F.lit("well")}),
        t("characters").withColumns({"role": F.when(F.col("significance") > 2, "guard").otherwise(""), "status": F.when(F.col("significance") > 2, "hurt"), "significance": F.lit(3)}), ["id"], state.CHARACTER_RULES,
    ).select("id", "significance", "role", "status")
)
query("up_location", "SELECT id, name, CASE WHEN name LIKE '%1' THEN parent ELSE 'new' END AS parent FROM locations")(
    lambda t: state.merge(t("locations"), t("locations").withColumn("parent", F.when(F.col("name").like("%1"), F.lit("")).otherwise("new")), ["id"], {"parent": state.keep_filled})
)
query("up_loc_adj", "SELECT DISTINCT e.chat_id, least(e.location_id, f.location_id) AS a, greatest(e.location_id, f.location_id) AS b FROM chains c JOIN story_events e ON e.id = c.from_id JOIN story_events f ON f.id = c.to_id WHERE e.location_id <> f.location_id UNION SELECT DISTINCT chat_id, 'loc-0', 'loc-1' FROM story_events")(
    lambda t: state.adjacency(
        t("chains").join(t("story_events").select(F.col("id").alias("from_id"), "chat_id", F.col("location_id").alias("a")), "from_id").join(t("story_events").select(F.col("id").alias("to_id"), F.col("location_id").alias("b")), "to_id").select("chat_id", F.col("a").alias("from_id"), F.col("b").alias("to_id"))
        .unionByName(t("story_events").select("chat_id", F.lit("loc-1").alias("from_id"), F.lit("loc-0").alias("to_id")))
    )
)
query("up_relation", "SELECT from_id, to_id, session_id, CASE WHEN intensity > 0.5 THEN 1.0 ELSE intensity END::DOUBLE AS intensity FROM feels")(
    lambda t: state.merge(t("feels"), t("feels").where("intensity > 0.5").withColumn("intensity", F.lit(1.0)), ["from_id", "to_id", "session_id"]).select("from_id", "to_id", "session_id", "intensity")
)
query("up_event", "SELECT id, CASE WHEN significance > 3 THEN 'x' ELSE source_text END AS source_text, CASE WHEN significance > 2 THEN 'later' ELSE world_time END AS world_time, location_id FROM story_events")(
    lambda t: state.merge(
        t("story_events").select("id", "source_text", "world_time", "location_id"),
        t("story_events").select("id", F.when(F.col("significance") > 3, "x").otherwise("").alias("source_text"), F.when(F.col("significance") > 2, " later").otherwise(" ").alias("world_time"), F.lit("loc-0").alias("location_id")), ["id"], state.EVENT_RULES,
    )
)
query("up_snapshot", "SELECT id, CASE WHEN message_index > 1000 THEN 'over' ELSE tone END AS tone FROM snapshots")(lambda t: state.merge(t("snapshots").select("id", "tone"), t("snapshots").where("message_index > 1000").select("id", F.lit("over").alias("tone")), ["id"]))
query("up_presence", "SELECT character_id, location_id, is_current AND character_id NOT LIKE '%7' AS is_current FROM present_at WHERE chat_id = 'BUILDING' UNION ALL SELECT DISTINCT character_id, 'loc-0', true FROM present_at WHERE chat_id = 'BUILDING' AND character_id LIKE '%7'")(
    lambda t: state.presence(
        t("present_at").where("chat_id = 'BUILDING'").select("character_id", "location_id", "chat_id", "is_current"),
        t("present_at").where("chat_id = 'BUILDING' AND character_id LIKE '%7'").select("character_id", F.lit("loc-0").alias("location_id"), "chat_id").distinct(),
    ).select("character_id", "location_id", "is_current")
)
query("up_plot", "SELECT id, coalesce(resolved_at, planted_at + 5) AS resolved_at FROM plot_threads")(lambda t: state.merge(t("plot_threads").select("id", "resolved_at"), t("plot_threads").select("id", (F.col("planted_at") + 5).alias("resolved_at")), ["id"], state.PLOT_RULES))
query("up_plot_resolve", "SELECT id, CASE WHEN chat_id = 'BUILDING' AND id LIKE 'plot-7%' THEN coalesce(resolved_at, 99) ELSE resolved_at END AS resolved_at FROM plot_threads")(
    lambda t: state.merge(t("plot_threads").select("id", "chat_id", "resolved_at"), t("plot_threads").where("id LIKE 'plot-7%' AND chat_id = 'BUILDING'").select("id", "chat_id", F.lit(99).alias("resolved_at")), ["id", "chat_id"], state.PLOT_RULES).select("id", "resolved_at")
)
query("up_chain", "SELECT from_id, to_id FROM chains")(lambda t: state.insert_new(t("chains").where("from_id < to_id"), t("chains"), ["from_id", "to_id"]).select("from_id", "to_id"))
query("up_arc", "SELECT id, chat_id, CASE WHEN hierarchy_level = 1 THEN 5 ELSE importance END AS importance FROM story_arcs")(lambda t: state.merge(t("story_arcs"), t("story_arcs").where("hierarchy_level = 1").withColumn("importance", F.lit(5)), ["id"]).select("id", "chat_id", "importance"))
_TA, _TB = TRIGRAMS.format("lower(n.content)"), TRIGRAMS.format("lower(k.content)")
_LIKE = f"round(len(list_intersect({_TA}, {_TB})) / len(list_distinct(list_concat({_TA}, {_TB})))::DOUBLE, 9)"
query("up_fact", f"""SELECT new_id, id FROM (SELECT n.id AS new_id, k.id, row_number() OVER (PARTITION BY n.id ORDER BY (k.id IS NULL), length(k.content) DESC, {_LIKE} DESC, k.id) AS r FROM (SELECT * FROM facts WHERE domain = 'backstory') n
    LEFT JOIN facts k ON k.domain = n.domain AND k.id <> n.id AND (contains(lower(n.content), lower(k.content)) OR contains(lower(k.content), lower(n.content)) OR {_LIKE} > 0.45)) x WHERE r = 1""")(
    lambda t: state.match_facts(t("facts").where("domain = 'backstory'"), t("facts"))
)
query("up_trait")(lambda t: traits.fold(t("traits")))
query("up_trait_batch")(lambda t: traits.fold(t("traits"), traits.OFFLINE_MERGE_FROM, traits.OFFLINE_MERGE_FROM, True))
query("up_trait_merge")(lambda t: traits.fold(t("traits")).groupBy("canonical_id").agg(F.count("*").alias("wordings")))
query("trait_norm_dedup", "SELECT character_id, category, regexp_replace(lower(content), '[^a-z0-9]', '', 'g') AS norm, min(id) AS id, count(*) AS n FROM traits GROUP BY ALL")(lambda t: t("traits").groupBy("character_id", "category", X.norm_content("content").alias("norm")).agg(F.min("id").alias("id"), F.count("*").alias("n")))
query("up_summary_emb", "WITH p AS (SELECT character_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM traits), c AS (SELECT character_id, i, avg(CAST(x AS DOUBLE)) AS v FROM p GROUP BY character_id, i) SELECT character_id, round(max(v), 6) AS most, round(min(v), 6) AS least FROM c GROUP BY character_id")(
    lambda t: V.mean_vectors(t("traits"), "character_id").select("character_id", F.round(F.array_max("centroid"), 6).alias("most"), F.round(F.array_min("centroid"), 6).alias("least"))
)
query("up_clear_msg", "SELECT 'events' AS rows, count(*) AS n FROM story_events WHERE NOT (chat_id = 'BUILDING' AND message_index = 7) UNION ALL SELECT 'participated', count(*) FROM participated WHERE event_id NOT IN (SELECT id FROM story_events WHERE chat_id = 'BUILDING' AND message_index = 7)")(
    lambda t: (lambda o: o["events"].agg(F.lit("events").alias("rows"), F.count("*").alias("n")).unionByName(o["participated"].agg(F.lit("participated").alias("rows"), F.count("*").alias("n"))))(state.clear_message({"events": t("story_events"), "participated": t("participated")}, "BUILDING", 7))
)
query("up_clear_char", "SELECT 'participated' AS \"table\", count(*) AS removed FROM participated WHERE character_id = 'chr-s7' UNION ALL SELECT 'present_at', count(*) FROM present_at WHERE character_id = 'chr-s7' AND chat_id = 'BUILDING'")(
    lambda t: state.clear_character({"participated": t("participated"), "present_at": t("present_at")}, ["chr-s7"], ["BUILDING"])[1]
)
_TO = "CASE {0} WHEN 'chr-s7' THEN 'chr-s8' WHEN 'chr-s9' THEN 'chr-s8' WHEN 'chr-c7' THEN 'chr-c8' ELSE {0} END"
_MERGED = {
    "feels": (("from_id", "to_id"), ("session_id",)), "knows": (("character_id",), ("fact_id", "chat_id")), "participated": (("character_id",), ("event_id",)), "plot_characters": (("character_id",), ("plot_id",)),
    "traits": (("character_id",), ("category", "normalized_content")), "present_at": (("character_id",), None), "items": (("owner_id",), None),
}


def _merge_tables(t) -> dict:
    out = {name: t(name) for name in _MERGED}
    out["knows"] = out["knows"].withColumn("character_id", F.concat(F.lit("chr-s"), F.regexp_replace("character_id", "[^0-9]", "")))
    out["traits"] = out["traits"].select(F.concat(F.lit("chr-s"), F.regexp_replace("character_id", "[^0-9]", "")).alias("character_id"), "category", X.norm_content("content").alias("normalized_content")).distinct()
    people = t("characters").withColumns({"aliases": F.array("alias"), "description": F.when(F.col("id") == "chr-s8", "").otherwise(F.col("name"))})
    named = t("snapshot_chars").groupBy(F.col("snapshot_id").alias("id")).agg(F.array_sort(F.collect_set("character_id")).alias("present_chars"))
    return out | {"characters": people.drop("alias"), "snapshots": named}


def _merged(t) -> dict:
    ids = t.spark.createDataFrame([("chr-s7", "chr-s8"), ("chr-s9", "chr-s8"), ("chr-c7", "chr-c8")], "old string, new string")
    return identity.merge_characters(_merge_tables(t), ids)


def _merged_rows(t):
    out, rows = _merged(t), None
    for name, (columns, _) in _MERGED.items():
        own = [F.count_if(F.col(c).isin("chr-s8", "chr-c8")) for c in columns]
        n = out[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), sum(own[1:], own[0]).alias("own"))
        rows = n if rows is None else rows.unionByName(n)
    return rows


def _merged_sql() -> str:
    digits = "'chr-s' || regexp_replace(character_id, '[^0-9]', '', 'g') AS character_id"
    of = {"knows": f"(SELECT {digits}, fact_id, chat_id FROM knows) x", "traits": f"(SELECT DISTINCT {digits}, category, regexp_replace(lower(content), '[^a-z0-9]', '', 'g') AS normalized_content FROM traits) x"}
    parts = []
    for name, (columns, key) in _MERGED.items():
        to = ", ".join(f"{_TO.format(c)} AS {c}" for c in columns)
        some = f"SELECT DISTINCT {to}, {', '.join(key)}" if key else f"SELECT {to}"
        own = " + ".join(f"count(*) FILTER ({c} IN ('chr-s8', 'chr-c8'))" for c in columns)
        parts.append(f"SELECT '{name}' AS name, count(*) AS n, {own} AS own FROM ({some} FROM {of.get(name, name)}) y")
    return " UNION ALL ".join(parts)


query("up_merge_chars", _merged_sql())(_merged_rows)
query("up_merge_chars_rows", "SELECT id, name, CASE id WHEN 'chr-s8' THEN array_to_string(list_sort(list_distinct([alias, 'Supplier#000000007', 'supplier#000000007', 'Supplier#000000009', 'supplier#000000009'])), '|') WHEN 'chr-c8' THEN array_to_string(list_sort([alias, 'Customer#000000007', 'customer#000000007']), '|') ELSE alias END AS aliases, CASE WHEN id = 'chr-s8' THEN 'Supplier#000000007' ELSE name END AS description FROM characters WHERE id NOT IN ('chr-s7', 'chr-s9', 'chr-c7')")(
    lambda t: _merged(t)["characters"].select("id", "name", F.array_join("aliases", "|").alias("aliases"), "description")
)
query("up_merge_chars_arrays", f"SELECT snapshot_id AS id, string_agg(DISTINCT {_TO.format('character_id')}, '|' ORDER BY {_TO.format('character_id')}) AS present FROM snapshot_chars GROUP BY snapshot_id")(
    lambda t: _merged(t)["snapshots"].select("id", F.array_join("present_chars", "|").alias("present"))
)
query("rd_audit_dups", "SELECT name, id, size, events, row_number() OVER (PARTITION BY name ORDER BY events DESC, id) = 1 AS keep FROM (SELECT lower(p_name) AS name, concat('itm-', p_partkey) AS id, count(*) OVER (PARTITION BY lower(p_name)) AS size, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS events FROM part) x WHERE size >= 2")(
    lambda t: identity.duplicates(t("part").select(F.concat(F.lit("itm-"), "p_partkey").alias("id"), F.col("p_name").alias("name")), t("lineitem").select(F.concat(F.lit("itm-"), "l_partkey").alias("character_id")))
)
_FORMS = "SELECT id, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS f FROM characters UNION SELECT id, trim(regexp_replace(lower(alias), '\\s+', ' ', 'g')) FROM characters"
query("rd_resolve_ids", f"SELECT c.c_name AS name, f.id FROM customer c JOIN ({_FORMS}) f ON f.f = lower(c.c_name) UNION SELECT c_name, 'chr-' || regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') FROM customer")(
    lambda t: identity.resolve(t("characters"), t("customer").select(F.concat(F.col("c_name"), F.lit("")).alias("name"))).select("name", "id")
)
query("rd_flatten_ids", f"SELECT DISTINCT f.id FROM customer c JOIN ({_FORMS}) f ON f.f = lower(c.c_name)")(lambda t: identity.resolve(t("characters"), t("customer").select(F.col("c_name").alias("name")), None, False).select("id").distinct())
query("rd_find_char", "SELECT id, name FROM characters WHERE alias = 'supplier#000000007' ORDER BY id LIMIT 1")(lambda t: identity.find(t("characters"), "Supplier#000000007").select("id", "name"))
_ROWS = "SELECT chat_id, message_index, name || ': ' || mes AS said FROM messages WHERE NOT is_system AND length(name || ': ' || mes) >= 80"
query("up_messages", f"SELECT 'mem-' || substr(sha1(chat_id || '|' || message_index || '|' || i), 1, 16) AS id, chat_id, CASE WHEN length(said) > 2000 THEN 'message_chunk' ELSE 'message' END AS node_type, message_index, substr(said, CAST(i * 1600 + 1 AS INT), 2000) AS content FROM (SELECT *, unnest(range(0, CAST(1 + greatest(ceil((length(said) - 2000) / 1600.0), 0) AS BIGINT))) AS i FROM ({_ROWS}) a) b")(
    lambda t: ingest.message_rows(t("messages"))
)
query("up_backfill_emb", "SELECT id FROM traits WHERE id % 5 = 4")(
    # one condition on both columns would be taken for the join of the documents and the embeddings, and pair them all
    lambda t: t("traits").where("id % 5 = 4").select("id").unionByName(t("traits").where("id % 5 <> 4 AND embedding IS NULL").select("id"))
)
query("up_backfill_ctx", """SELECT a.id, md5(string_agg(b.raw_text, chr(10) || '---' || chr(10) ORDER BY b.message_index, b.node_id)) AS context_prefix FROM memory a JOIN memory b ON b.chat_id = a.chat_id AND b.message_index BETWEEN a.message_index - 4 AND a.message_index + 4 WHERE a.id % 3 = 0 GROUP BY a.id
    UNION ALL SELECT id, 'known' FROM memory WHERE id % 3 <> 0""")(lambda t: models.backfill_context(t("memory").withColumn("context_prefix", F.when(F.col("id") % 3 != 0, "known")), lambda chat, around, text: F.md5(around)).select("id", "context_prefix"))
query("snk_store_emb", "SELECT chat_id, nullif(message_index, 0) AS message_index FROM memory")(lambda t: t("memory").select("chat_id", F.nullif("message_index", F.lit(0)).alias("message_index")))
query("snk_upsert_mem", "SELECT chat_id, node_id, CASE WHEN id % 10 = 0 THEN 'new' ELSE content END AS content FROM memory")(
    lambda t: state.replace(t("memory").select("chat_id", "node_type", "node_id", "content"), t("memory").where("id % 10 = 0").select("chat_id", "node_type", "node_id", F.lit("new").alias("content")), ["chat_id", "node_type", "node_id"]).select("chat_id", "node_id", "content")
)
query("snk_upsert_quote", "SELECT id, quote FROM quotes")(lambda t: state.insert_new(t("quotes").where("message_index < 3"), t("quotes"), ["id"]).select("id", "quote"))
query("snk_status", "SELECT chat_id, CASE WHEN messages_total > 5 THEN 'again' ELSE status END AS status FROM ingestion")(lambda t: state.merge(t("ingestion"), t("ingestion").where("messages_total > 5").withColumn("status", F.lit("again")), ["chat_id"]).select("chat_id", "status"))
query("snk_results", "SELECT b.item_id AS question_id, m.model, c.cond FROM benchmark b CROSS JOIN models m CROSS JOIN conditions c WHERE NOT (b.item_id % 2 = 0 AND c.cond_ord = 0)")(
    lambda t: evaluation.remaining(evaluation.matrix(t("benchmark").select(F.col("item_id").alias("question_id")), t("models"), t("conditions")), t("answers").where("question_id % 2 = 0 AND cond = 'raw-16k-only'")).select("question_id", "model", "cond")
)
query("snk_report")(lambda t: t.spark.createDataFrame([(evaluation.markdown(t("answers")),)], "text string"))

# streams, in their batch form
_reply = lambda prompt: '{"events": [{"summary": "' + hashlib.md5(prompt.encode()).hexdigest() + '"}]}'
query("st_bulk", "SELECT 'evt-' || substr(sha1(md5(p) || '|' || chat_id || '|' || batch), 1, 16) AS id, chat_id, batch AS message_index FROM (SELECT chat_id, CAST(floor(message_index / 10) * 10 AS INT) AS batch, string_agg(name || ': ' || mes, chr(10) ORDER BY message_index) AS p FROM messages GROUP BY ALL) x")(
    lambda t: extraction.bulk({n: t.spark.createDataFrame([], s) for n, s in extraction.TABLES.items()}, t("messages"), _reply, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))["events"].select("id", "chat_id", "message_index")
)
_RECORD = """to_json(named_struct('characters', array(named_struct('name', concat('Teller ', o_custkey % 50), 'aliases', array(o_orderpriority), 'description', if(o_orderkey % 3 = 0, summary, ''), 'role', if(o_orderkey % 4 = 1, o_orderstatus, ''), 'significance', significance)),
    'locations_detail', array(named_struct('name', location_id, 'description', if(o_orderkey % 5 = 2, summary, ''), 'importance', significance)), 'present', array(named_struct('character', concat('Teller ', o_custkey % 50), 'location', location_id))))"""


def _extracted(t, keep=lambda records: records) -> dict:
    """keep: what becomes of the parsed records, which each table that is asked for reads again."""
    rows = t("story_events").join(t("orders"), F.col("orderkey") == F.col("o_orderkey"))
    raw = rows.select("chat_id", "message_index", F.col("ts").cast("timestamp_ntz").alias("at"), F.expr(_RECORD).alias("reply"))
    return extraction.apply({n: t.spark.createDataFrame([], s) for n, s in extraction.TABLES.items()}, keep(extraction.parse(raw)))


_SAID = "FROM (SELECT e.*, o.*, concat('Teller ', o_custkey % 50) AS who FROM story_events e JOIN orders o ON o.o_orderkey = e.orderkey) e GROUP BY"
query("up_extraction", f"""SELECT chat_id, who AS name, coalesce(arg_max(summary, message_index) FILTER (o_orderkey % 3 = 0), '') AS description, coalesce(arg_max(o_orderstatus, message_index) FILTER (o_orderkey % 4 = 1), '') AS role,
    max(significance) AS significance, count(DISTINCT o_orderpriority) AS aliases {_SAID} chat_id, who""")(
    lambda t: _extracted(t)["characters"].select("chat_id", "name", "description", "role", "significance", F.size("aliases").cast("long").alias("aliases"))
)
query("up_extraction_places", f"SELECT max(e.location_id) AS name, coalesce(arg_max(summary, (message_index, chat_id)) FILTER (o_orderkey % 5 = 2), '') <> '' AS told, max(significance) AS importance {_SAID} e.location_id")(
    lambda t: _extracted(t)["locations"].select("name", (F.col("description") != "").alias("told"), "importance")
)
query("up_extraction_presence", f"SELECT chat_id, who, count(*) AS arrivals, replace(arg_max(e.location_id, message_index), 'loc-', 'loc-loc-') AS place {_SAID} chat_id, who")(
    lambda t: (lambda out: out["present_at"].groupBy(F.col("character_id").alias("id"), "chat_id").agg(F.count("*").alias("arrivals"), F.max(F.when(F.col("is_current"), F.col("location_id"))).alias("place"))
    .join(out["characters"].select("id", "chat_id", F.col("name").alias("who")), ["id", "chat_id"]).select("chat_id", "who", "arrivals", "place"))(_extracted(t, stored))
)
query("st_padding", "SELECT chat_id, message_index FROM (SELECT *, max(message_index) OVER (PARTITION BY chat_id) AS m FROM messages) x WHERE message_index <= m - 5")(lambda t: ingest.settled(t("messages")).select("chat_id", "message_index"))
query("st_every_n", "SELECT chat_id, message_index FROM messages WHERE message_index % 3 = 0")(lambda t: ingest.every(t("messages"), 3).select("chat_id", "message_index"))
query("st_retract", "SELECT id FROM story_events WHERE NOT (chat_id = 'BUILDING' AND message_index = 7)")(lambda t: state.clear_message({"events": t("story_events"), "participated": t("participated")}, "BUILDING", 7)["events"].select("id"))
query("st_idempotent", "SELECT id, chat_id FROM quotes")(lambda t: state.insert_new(state.insert_new(t("quotes").where("message_index < 2"), t("quotes"), ["id"]), t("quotes"), ["id"]).select("id", "chat_id"))
query("st_trigger_n", "SELECT chat_id, message_index FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY message_index, id) AS n FROM story_events) x WHERE n % 30 = 0")(lambda t: ingest.rebuild_points(t("story_events")))
query("st_recent_window", """SELECT a.chat_id, a.message_index, string_agg(DISTINCT b.name, ',' ORDER BY b.name) AS names, md5(right(string_agg(b.mes, chr(10) ORDER BY b.message_index), 8000)) AS text
    FROM messages a JOIN messages b ON b.chat_id = a.chat_id AND b.message_index BETWEEN a.message_index - 9 AND a.message_index GROUP BY a.chat_id, a.message_index""")(
    lambda t: ingest.recent_window(t("messages")).select("chat_id", "message_index", F.array_join("names", ",").alias("names"), F.md5("text").alias("text"))
)
query("st_context_window", """WITH m AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY message_index) AS n FROM messages WHERE NOT is_system)
    SELECT a.chat_id, a.message_index, md5(string_agg(substr(b.mes, 1, 400), chr(10) ORDER BY b.n)) AS context FROM m a JOIN m b ON b.chat_id = a.chat_id AND b.n BETWEEN a.n - 4 AND a.n + 4 GROUP BY a.chat_id, a.message_index""")(
    lambda t: ingest.context_window(t("messages")).select("chat_id", "message_index", F.md5("context").alias("context"))
)
query("st_scene_window", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY chat_id ORDER BY message_index DESC) AS r FROM snapshots) x WHERE r <= 3")(lambda t: t("snapshots").withColumn("r", F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc("message_index")))).where("r <= 3").select("id"))
query("st_activity", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(lambda t: ingest.activity(t("events")))
query("st_sessions", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
    (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events) a) b GROUP BY user_id, s""")(lambda t: ingest.sessions(t("events")))  # fmt: skip

# evaluation
query("ev_matrix", "SELECT b.item_id AS question_id, m.model, c.cond FROM benchmark b CROSS JOIN models m CROSS JOIN conditions c")(lambda t: evaluation.matrix(t("benchmark").select(F.col("item_id").alias("question_id")), t("models"), t("conditions")).select("question_id", "model", "cond"))
query("ev_resume", "SELECT question_id, model, cond FROM answers WHERE error IS NOT NULL")(lambda t: evaluation.remaining(t("answers"), t("answers").where("error IS NULL")).select("question_id", "model", "cond"))
query("ev_context", "SELECT doc_id, length('block' || chr(10) || chr(10) || right(text, 100 * 4 - 200 - 5)) AS n, md5('block' || chr(10) || chr(10) || right(text, 100 * 4 - 200 - 5)) AS v FROM documents")(
    lambda t: t("documents").select("doc_id", evaluation.context(F.col("text"), 100, F.lit("block")).alias("c")).select("doc_id", F.length("c").cast("long").alias("n"), F.md5("c").alias("v"))
)
query("ev_cost", "SELECT count(*) * 3 * 4 AS calls, count(*) * 3 * (2 * 16000 + 2 * 32000) AS input_tokens FROM benchmark")(
    lambda t: t("benchmark").agg(F.count("*").alias("n")).select(*[(F.col("n") * v).alias(k) for k, v in evaluation.cost(1, 3, [16000, 32000]).items()])
)
query("ev_judge", "SELECT question_id, model, cond, CASE WHEN error IS NULL THEN least(2, greatest(0, score * 2 - 1)) ELSE 0 END AS score FROM answers")(
    lambda t: t("answers").select("question_id", "model", "cond", evaluation.judged(F.when(F.col("error").isNull(), F.concat(F.lit('Verdict: {"score": '), F.col("score") * 2 - 1, F.lit(', "reason": "r"}'))).otherwise("no answer")).alias("j")).select("question_id", "model", "cond", "j.score")
)
query("ev_report", "SELECT question_id, model, cond FROM answers WHERE score = 0 ORDER BY question_id, model, cond LIMIT 10")(lambda t: t("answers").where("score = 0").orderBy("question_id", "model", "cond").limit(10).select("question_id", "model", "cond"))


def _question(prompt: str) -> str:
    digest = hashlib.md5(prompt.encode()).hexdigest()
    return "none comes to mind" if digest[0] == "0" else f'Here:\n```json\n{{"question": "{digest}", "ground_truth": "yes",}}\n```'


query("ev_qgen", f"SELECT printf('q-%03d', item_id + 1) AS id, md5('{models.QUESTION}' || text) AS question, item_id * 1000 AS chunk_offset FROM benchmark WHERE md5('{models.QUESTION}' || text) NOT LIKE '0%'")(
    lambda t: models.questions(t("benchmark").select(F.col("item_id").alias("idx"), (F.col("item_id") * 1000).alias("chunk_offset"), F.col("text").alias("chunk")), _question).select("id", "question", "chunk_offset")
)
