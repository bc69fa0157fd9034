"""Search, fusion, rendering and the structured reads, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import english
from ..operators import graph, postings, pov, reads, search
from . import render
from .catalog_functions import TRIGRAMS, query_vector
from .registry import query
from .retrieve import Request, block, retrieve, scoped

C_MEM, C_EVT, C_CONV = "src:src1", "BUILDING", "conv-1"
CHATS = ["src:src1", "src:src2", "BUILDING", "conv-1", "conv-2", "conv-3"]
_IN = "chat_id IN (" + ", ".join(f"'{c}'" for c in CHATS) + ")"
_V = "CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])"
_SIM = f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_V}), 9)"
#: A fixed query, of words that the synthetic texts and events share.
TEXT = "the urgent medium order thea tion onea supplier#000000007 and brand"
QUOTE = "tion thea onea"


def ranked_sql(rows: str, text: str, query_: str, limit: str) -> str:
    """id, rank, message_index, chat_id of the best rows by English OR rank, the stems found by SQL rules of their own."""
    terms = english.query_lexemes(search.terms_of(query_))
    own = ", ".join(f"'{t}'" for t in terms)
    return f"""SELECT id, rank, message_index, chat_id FROM (WITH hits AS (SELECT * FROM {rows} WHERE {_IN}), {english.lexemes_sql('hits', 'id', text)}
      SELECT h.id, round(sum(list_sum(list_transform(range(1, c.n + 1), lambda j: 1.0::DOUBLE / (j * j)))) * (0.1 / 1.64493406685) / {len(terms)}, 9) AS rank, h.message_index, h.chat_id
      FROM (SELECT id, stem, count(*) AS n FROM lexemes WHERE stem IN ({own}) GROUP BY id, stem) c JOIN hits h ON h.id = c.id GROUP BY h.id, h.message_index, h.chat_id) z ORDER BY rank DESC, id LIMIT {limit}"""


MEM_VEC = f"SELECT id, {_SIM} AS similarity, message_index, chat_id FROM memory WHERE {_IN} ORDER BY similarity DESC, id LIMIT {{n}}"
MEM_TEXT = ranked_sql("memory", "content", TEXT, "{n}")
EVT_VEC = f"SELECT id, {_SIM} AS similarity, message_index, chat_id FROM event_vectors WHERE {_IN} ORDER BY similarity DESC, id LIMIT {{n}}"
EVT_TEXT = ranked_sql("story_events", "source_text", TEXT, "{n}")
SNAP_VEC = f"SELECT id, {_SIM} AS similarity, message_index, chat_id FROM snapshots WHERE {_IN} ORDER BY similarity DESC, id LIMIT {{n}}"


def _dialogue(q: str, n: int) -> str:
    a, b = TRIGRAMS.format("quote"), TRIGRAMS.format(f"'{q}'")
    like = f"round(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE, 9)"
    return f"""SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score, min(message_index) AS message_index, min(chat_id) AS chat_id FROM (
      SELECT id, message_index, chat_id, row_number() OVER (ORDER BY rank DESC, id) AS r FROM ({ranked_sql("quotes", "quote", q, str(2 * n))}) t
      UNION ALL SELECT id, message_index, chat_id, row_number() OVER (ORDER BY rank DESC, id) FROM (SELECT id, message_index, chat_id, {like} AS rank FROM quotes WHERE {_IN} AND {like} >= 0.3 ORDER BY rank DESC, id LIMIT {2 * n}) u) y
      GROUP BY id ORDER BY score DESC, id LIMIT {n}"""


_MENTIONED = f"SELECT id, name FROM characters WHERE ((length(name) >= 3 AND contains('{TEXT}', lower(name))) OR (length(alias) >= 3 AND contains('{TEXT}', alias))) AND id IN (SELECT p.character_id FROM participated p JOIN story_events e ON e.id = p.event_id WHERE {_IN})"
_BOOST = f"SELECT id, significance, message_index, chat_id FROM story_events WHERE {_IN} AND id IN (SELECT event_id FROM participated WHERE character_id IN (SELECT id FROM ({_MENTIONED}) q)) ORDER BY significance DESC, message_index DESC, id LIMIT 30"

query("se_vec_mem", MEM_VEC.format(n=5).replace("similarity, message_index, chat_id", "similarity"))(lambda t: search.vector_memory(t("memory"), CHATS, query_vector(t)).select("id", "similarity"))
query("se_lex_mem", MEM_TEXT.format(n=5).replace("rank, message_index, chat_id", "rank"))(lambda t: search.text_memory(t("memory"), CHATS, TEXT).select("id", "rank"))
query("se_lex_index", MEM_TEXT.replace(f"WHERE {_IN}", "WHERE true").format(n=50).replace("rank, message_index, chat_id", "rank"))(
    lambda t: postings.ranked(postings.build(t("memory"), "content", ["id", "chat_id", "message_index"]), english.query_lexemes(search.terms_of(TEXT)), 50).select("id", "rank")
)
query("se_vec_evt", EVT_VEC.format(n=5).replace("similarity, message_index, chat_id", "similarity"))(lambda t: search.vector_events(t("event_vectors"), CHATS, query_vector(t)).select("id", "similarity"))
query("se_lex_evt", EVT_TEXT.format(n=5).replace("rank, message_index, chat_id", "rank"))(lambda t: search.text_events(t("story_events"), CHATS, TEXT).select("id", "rank"))
query("se_vec_snap", f"SELECT s.id, s.similarity, l.name AS location_name FROM (SELECT id, location_id, {_SIM} AS similarity FROM snapshots WHERE {_IN} ORDER BY similarity DESC, id LIMIT 5) s LEFT JOIN locations l ON l.id = s.location_id")(
    lambda t: search.vector_snapshots(t("snapshots"), t("locations"), CHATS, query_vector(t)).select("id", "similarity", "location_name")
)
query("se_dialogue", f"SELECT id, score FROM ({_dialogue(QUOTE, 10)}) d")(lambda t: search.dialogue(t("quotes"), CHATS, QUOTE, 10).select("id", "score"))
query("se_max_idx", f"SELECT greatest(coalesce((SELECT max(message_index) FROM memory WHERE {_IN}), 0), coalesce((SELECT max(message_index) FROM story_events WHERE {_IN}), 0)) AS top")(
    lambda t: search.top_index([search._scoped(t("memory"), CHATS), search._scoped(t("story_events"), CHATS)])
)
query("se_mention", _MENTIONED)(lambda t: search.mentioned(t("characters"), t("participated"), t("story_events"), CHATS, TEXT))
query("se_graph_boost", _BOOST.replace("SELECT id, significance, message_index, chat_id", "SELECT id, significance", 1))(
    lambda t: search.boosted(t("story_events"), t("participated"), CHATS, search.mentioned(t("characters"), t("participated"), t("story_events"), CHATS, TEXT)).select("id", "significance")
)


def hybrid_sql(limit: int, caps: dict, budgets: bool = False) -> str:
    many = max(limit, 8) * 3
    parts = [
        ("memory", "similarity DESC, id", MEM_VEC.format(n=many)), ("memory", "rank DESC, id", MEM_TEXT.format(n=many)), ("event", "rank DESC, id", EVT_TEXT.format(n=min(30, 2 * limit))),
        ("event", "similarity DESC, id", EVT_VEC.format(n=many)), ("dialogue", "score DESC, id", _dialogue(TEXT, limit)), ("snapshot", "similarity DESC, id", SNAP_VEC.format(n=many)),
        ("event", "significance DESC, message_index DESC, id", _BOOST),
    ]
    union = "\nUNION ALL ".join(f"SELECT '{k}' AS kind, CAST(id AS VARCHAR) AS id, message_index, {i} AS place, row_number() OVER (ORDER BY {o}) AS r FROM ({q}) s{i}" for i, (k, o, q) in enumerate(parts))
    case = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in caps.items()) + " END"
    n = max(limit, sum(caps.values())) if budgets else limit
    return f"""WITH ranked AS ({union}), top AS (SELECT max(message_index) AS m FROM (SELECT message_index FROM memory WHERE {_IN} UNION ALL SELECT message_index FROM story_events WHERE {_IN}) z),
    fused AS (SELECT kind, id, sum(1.0::DOUBLE / (60 + r)) AS s, min(message_index) AS message_index, min(place * 100000 + r) AS first FROM ranked GROUP BY kind, id),
    scored AS (SELECT kind, id, message_index, first, round(s + CASE WHEN m > 0 AND message_index IS NOT NULL THEN 0.003::DOUBLE * message_index / m ELSE 0.0 END, 9) AS score FROM fused CROSS JOIN top),
    capped AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, first, id) AS k FROM scored)
    SELECT kind, id, score FROM capped WHERE k <= {case} ORDER BY score DESC, first, id LIMIT {n}"""


def _hybrid(t, limit: int = 20, budgets=None):
    ids = search.mentioned(t("characters"), t("participated"), t("story_events"), CHATS, TEXT)
    return search.hybrid(t, CHATS, query_vector(t), TEXT, limit, ids, budgets)


query("se_hybrid", hybrid_sql(20, search.DEFAULT_CAPS))(lambda t: _hybrid(t).select("kind", "id", "score"))
query("se_hybrid_budgets", hybrid_sql(40, {k: search.BUDGETS["inject"][k] for k in search.DEFAULT_CAPS}, True))(lambda t: _hybrid(t, 40, search.resolve_budgets()).select("kind", "id", "score"))
query("se_fallback", f"SELECT 'memory' AS kind, CAST(id AS VARCHAR) AS id, round(1.0::DOUBLE / (60 + row_number() OVER (ORDER BY rank DESC, id)), 9) AS score FROM ({MEM_TEXT.format(n=60)}) x ORDER BY score DESC LIMIT 12")(
    lambda t: search.hybrid(t, CHATS, None, TEXT, 20, None, search.resolve_budgets()).select("kind", "id", "score")
)
_HITS = f"SELECT chat_id, message_index FROM ({MEM_VEC.format(n=10)}) h"
query("se_neighbor", f"SELECT chat_id, message_index, min(id) AS id FROM memory WHERE (chat_id, message_index) IN (SELECT chat_id, message_index - 1 FROM ({_HITS}) a UNION SELECT chat_id, message_index + 1 FROM ({_HITS}) b) AND (chat_id, message_index) NOT IN ({_HITS}) GROUP BY chat_id, message_index")(
    lambda t: search.neighbours(t("memory"), search.vector_memory(t("memory"), CHATS, query_vector(t), 10)).select("chat_id", "message_index", "id")
)
query("se_arc_exp", """WITH a AS (SELECT arc_id, event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM arc_events WINDOW w AS (PARTITION BY arc_id ORDER BY position))
    SELECT event_id, arc_id, parent_arc_id, before, after FROM (SELECT a.*, s.parent_arc_id, row_number() OVER (PARTITION BY a.event_id ORDER BY s.importance DESC, a.arc_id) AS r FROM a JOIN story_arcs s ON s.id = a.arc_id AND s.hierarchy_level = 1
    JOIN story_events e ON e.id = a.event_id WHERE e.chat_id = 'BUILDING') x WHERE r = 1""")(
    lambda t: search.arc_context(t("story_events").where("chat_id = 'BUILDING'"), t("arc_events"), t("story_arcs"))
)
query("se_budget", "SELECT * FROM (VALUES ('inject', 12, 8, 10, 3, 3000), ('mindmap', 30, 0, 0, 0, 8000), ('panel', 5, 0, 5, 0, 1500)) v(profile, memory, event, dialogue, snapshot, chars)")(
    lambda t: t.spark.createDataFrame([(p, *[b[k] for k in ("memory", "event", "dialogue", "snapshot", "chars")]) for p in search.BUDGETS for b in [search.resolve_budgets(profile=p)]], "profile string, memory int, event int, dialogue int, snapshot int, chars int")
)


def _request(t) -> Request:
    return Request(CHATS, TEXT, query_vector(t), names=["src1", "src2"], ids=["chr-s7", "src1"], persona=["src2"], state_chats=["u7"])


query("se_retrieve")(lambda t: retrieve(t, _request(t))["hits"])
def _block(t, max_tokens: int | None = None):
    own = scoped(t, CHATS)
    return block(own, retrieve(own, _request(t)), max_tokens)


query("rn_block")(lambda t: _block(t))
query("snk_render")(lambda t: _block(t, 200))
_STATE_TOP = "SELECT id, key, value, valid_from FROM world_state WHERE chat_id = 'u7' AND valid_until IS NULL ORDER BY valid_from DESC, id DESC LIMIT 20"
_THREAD_TOP = "SELECT id, importance, status, title FROM plot_threads WHERE chat_id = 'BUILDING' AND resolved_at IS NULL ORDER BY importance DESC, id LIMIT 20"
query("rn_sections", f"""SELECT '[Story Memory]' || chr(10) || chr(10) || '## World State' || chr(10) || (SELECT string_agg('- ' || key || ': ' || value, chr(10) ORDER BY valid_from DESC, id DESC) FROM ({_STATE_TOP}) a)
    || chr(10) || chr(10) || '## Active Plot Threads' || chr(10) || (SELECT string_agg('- [' || status || '] ' || title, chr(10) ORDER BY importance DESC, id) FROM ({_THREAD_TOP}) b) || chr(10) || chr(10) || '[/Story Memory]' AS text""")(
    lambda t: render.block([render.threads(reads.plot_threads(t("plot_threads"), C_EVT)), render.world_state(reads.world_state(t("world_state"), "u7"))], 100_000)
)
query("rn_tokens", "SELECT * FROM (VALUES (1, 800), (2, 3000), (3, 6000)) v(k, chars)")(lambda t: t.spark.createDataFrame([(1, render.max_chars(200, 3000)), (2, render.max_chars(None, 3000)), (3, render.max_chars())], "k int, chars int"))

# structured reads
IDS = ["chr-c7", "chr-s7"]
_IDS = "('chr-c7', 'chr-s7')"
query("rd_relationships", f"SELECT x.from_id, x.to_id, a.name AS from_name, b.name AS to_name, x.intensity FROM (SELECT * FROM feels WHERE session_id = 'BUILDING' AND (from_id IN {_IDS} OR to_id IN {_IDS}) ORDER BY intensity DESC, from_id, to_id LIMIT 20) x JOIN characters a ON a.id = x.from_id JOIN characters b ON b.id = x.to_id")(
    lambda t: reads.relationships(t("feels"), t("characters"), IDS, C_EVT).select("from_id", "to_id", "from_name", "to_name", "intensity")
)
query("rd_recent_events", "SELECT e.id, coalesce(string_agg(c.name, ', ' ORDER BY c.name), '') AS who FROM (SELECT id FROM story_events WHERE chat_id = 'BUILDING' ORDER BY world_time IS NULL, world_time, message_index, id LIMIT 8) e LEFT JOIN participated p ON p.event_id = e.id LEFT JOIN characters c ON c.id = p.character_id GROUP BY e.id")(
    lambda t: reads.recent_events(t("story_events"), t("participated"), t("characters"), C_EVT).select("id", F.array_join("participants", ", ").alias("who"))
)
query("rd_knowledge", """SELECT 'known' AS side, character_id, fact_id FROM (SELECT character_id, fact_id, row_number() OVER (PARTITION BY character_id ORDER BY fact_id) AS r FROM (SELECT DISTINCT character_id, fact_id FROM knows WHERE chat_id IN ('en', 'de') AND character_id IN ('src1', 'src2')) a) b WHERE r <= 20
    UNION ALL SELECT 'unknown', character_id, fact_id FROM (SELECT c.character_id, f.id AS fact_id, row_number() OVER (PARTITION BY c.character_id ORDER BY f.id) AS r FROM (VALUES ('src1'), ('src2')) c(character_id) CROSS JOIN facts f
      WHERE f.domain IN ('secret', 'backstory') AND f.id IN (SELECT fact_id FROM knows WHERE chat_id IN ('en', 'de')) AND NOT EXISTS (SELECT 1 FROM knows k WHERE k.character_id = c.character_id AND k.fact_id = f.id)) d WHERE r <= 10""")(
    lambda t: reads.known_facts(t("knows"), t("facts"), ["src1", "src2"], ["en", "de"]).select(F.lit("known").alias("side"), "character_id", "fact_id").unionByName(
        reads.unknown_facts(t("knows"), t("facts"), ["src1", "src2"], ["en", "de"]).select(F.lit("unknown").alias("side"), "character_id", "fact_id"))
)
query("rd_world_state", _STATE_TOP)(lambda t: reads.world_state(t("world_state"), "u7").select("id", "key", "value", "valid_from"))
query("rd_plot_threads", _THREAD_TOP)(lambda t: reads.plot_threads(t("plot_threads"), C_EVT).select("id", "importance", "status", "title"))
query("rd_snapshots", "SELECT s.id, l.name AS location_name FROM (SELECT * FROM snapshots WHERE chat_id = 'BUILDING' ORDER BY message_index DESC, id LIMIT 3) s LEFT JOIN locations l ON l.id = s.location_id")(
    lambda t: reads.snapshots(t("snapshots"), t("locations"), C_EVT).select("id", "location_name")
)
_LAST3 = "SELECT lower(name) AS n FROM snapshot_chars WHERE chat_id = 'BUILDING' AND message_index IN (SELECT message_index FROM snapshots WHERE chat_id = 'BUILDING' ORDER BY message_index DESC LIMIT 3)"
query("rd_locations", f"SELECT DISTINCT c.name, l.name AS location FROM present_at p JOIN characters c ON c.id = p.character_id JOIN locations l ON l.id = p.location_id WHERE p.is_current AND p.chat_id = 'BUILDING' AND p.character_id LIKE 'chr-s%' AND lower(c.name) IN ({_LAST3})")(
    lambda t: reads.current_places(
        t("present_at"), t("characters"), t("locations"),
        t("snapshot_chars").join(reads.snapshots(t("snapshots"), t("locations"), C_EVT).select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_semi"),
        t("characters").where("id LIKE 'chr-s%'").select("id"), C_EVT,
    ).select("name", "location")
)
query("rd_traits", "SELECT id, 'chat' AS pool FROM traits WHERE character_id IN ('src1', 'src2') AND canonical_id IS NULL AND id IN (SELECT coalesce(canonical_id, id) FROM traits WHERE character_id IN ('src1', 'src2') AND source_chat = 't1') UNION ALL SELECT id, 'persona' FROM traits WHERE canonical_id IS NULL AND character_id = 'src3'")(
    lambda t: reads.visible_traits(t("traits"), ["src1", "src2"], "t1", ["src3"]).select("id", "pool")
)
query("rd_traits_one", "SELECT id, category, content FROM traits WHERE character_id = 'src1' AND canonical_id IS NULL")(lambda t: reads.visible_traits(t("traits"), ["src1"]).select("id", "category", "content"))
query("rd_panel_stats", f"SELECT (SELECT count(*) FROM story_events WHERE chat_id = 'BUILDING' AND id IN (SELECT event_id FROM participated WHERE character_id IN {_IDS})) AS events, (SELECT max(message_index) FROM story_events WHERE chat_id = 'BUILDING' AND id IN (SELECT event_id FROM participated WHERE character_id IN {_IDS})) AS last_seen, (SELECT count(*) FROM feels WHERE session_id = 'BUILDING' AND from_id IN {_IDS}) AS feelings, (SELECT count(*) FROM items WHERE chat_id = 'BUILDING' AND owner_id IN {_IDS}) AS items")(
    lambda t: reads.panel_stats(IDS, t("participated"), t("story_events"), t("feels"), t("items"), C_EVT)
)
query("rd_panel_events", f"SELECT e.id, p.character_id FROM story_events e JOIN participated p ON p.event_id = e.id AND p.character_id IN {_IDS} ORDER BY e.message_index DESC, e.ts DESC, e.id, p.character_id LIMIT 20")(
    lambda t: reads.panel_events(IDS, t("participated"), t("story_events"), 50).select("id", "character_id")
)
query("rd_panel_rels", "SELECT DISTINCT ON (f.to_id) f.to_id, c.name AS to_name, f.intensity FROM feels f JOIN characters c ON c.id = f.to_id WHERE f.from_id = 'chr-c7' ORDER BY f.to_id, f.session_id DESC, f.from_id DESC")(
    lambda t: reads.panel_relations(["chr-c7"], t("feels"), t("characters")).select("to_id", "to_name", "intensity")
)
query("rd_chats", "SELECT chat_id, max(t0) AS last_event FROM (SELECT chat_id, CAST(NULL AS TIMESTAMP) AS t0 FROM ingestion UNION ALL SELECT chat_id, ts FROM story_events) x GROUP BY chat_id")(lambda t: reads.chats(t("ingestion"), t("story_events")))
query("rd_chats_for_char", "SELECT DISTINCT e.chat_id FROM characters c JOIN participated p ON p.character_id = c.id JOIN story_events e ON e.id = p.event_id WHERE lower(c.name) = 'customer#000000007' OR c.alias = 'customer#000000007'")(
    lambda t: graph.chats_of(t("characters"), t("participated"), t("story_events"), "Customer#000000007")
)
query("rd_char_names", "SELECT id, name FROM characters ORDER BY name, id")(lambda t: t("characters").orderBy("name", "id").select("id", "name"))
query("rd_scope_pick", "SELECT DISTINCT chat_id FROM memory WHERE chat_id IN ('src:src3', 'src:src4')")(lambda t: search._scoped(t("memory"), ["src:src3", "", None, "src:src4"]).select("chat_id").distinct())
query("rd_known_entities", "SELECT id, title FROM plot_threads WHERE chat_id = 'BUILDING' AND resolved_at IS NULL ORDER BY importance DESC, id LIMIT 20")(
    lambda t: reads.known_entities(t("characters"), t("present_at"), t("locations"), t("items"), t("plot_threads"), t("knows"), t("world_state"), C_EVT, 100)["threads"]
)
query("rd_known_entities_state", "SELECT key, value, 500 - source_message_index AS age FROM world_state WHERE chat_id = 'u7' AND valid_until IS NULL ORDER BY valid_from DESC, id DESC LIMIT 30")(
    lambda t: reads.known_entities(t("characters"), t("present_at"), t("locations"), t("items"), t("plot_threads"), t("knows"), t("world_state"), "u7", 500)["state"]
)
_U = """here AS (SELECT id, message_index, location_id, chat_id FROM story_events WHERE chat_id = 'BUILDING' AND (message_index IS NULL OR message_index <= 1500)),
    seen AS (SELECT * FROM here WHERE id IN (SELECT event_id FROM participated WHERE character_id IN ('chr-c7', 'chr-s7')) UNION SELECT h.* FROM here h JOIN (SELECT DISTINCT location_id, chat_id FROM present_at WHERE character_id IN ('chr-c7', 'chr-s7')) p ON p.location_id = h.location_id AND p.chat_id = h.chat_id)"""
_uni = lambda t: pov.universe(t, IDS, C_EVT, 1500)
query("rd_known_universe_events", f"WITH {_U} SELECT id FROM seen")(lambda t: _uni(t)["events"])
query("rd_known_universe_characters", f"WITH {_U} SELECT DISTINCT character_id AS id FROM participated WHERE event_id IN (SELECT id FROM seen)")(lambda t: _uni(t)["characters"])
query("rd_known_universe_locations", f"WITH {_U} SELECT location_id AS id FROM seen UNION SELECT location_id FROM present_at WHERE chat_id = 'BUILDING' AND character_id IN ('chr-c7', 'chr-s7')")(lambda t: _uni(t)["locations"])
query("rd_known_universe", f"SELECT id FROM items WHERE chat_id = 'BUILDING' AND owner_id IN {_IDS}")(lambda t: _uni(t)["items"])
query("flt_pov_hits", f"WITH {_U} SELECT 'event' AS kind, id FROM seen UNION ALL SELECT 'memory', CAST(id AS VARCHAR) FROM memory WHERE chat_id = 'src:src1' AND message_index IN (SELECT message_index FROM seen)")(
    lambda t: pov.mask_hits(
        t("story_events").where("chat_id = 'BUILDING'").select(F.lit("event").alias("kind"), "id", "message_index").unionByName(t("memory").where("chat_id = 'src:src1'").select(F.lit("memory").alias("kind"), F.col("id").cast("string").alias("id"), "message_index")), _uni(t),
    ).select("kind", "id")
)
query("flt_pov_result", f"WITH {_U} SELECT id FROM story_events WHERE chat_id = 'FURNITURE' AND message_index IN (SELECT message_index FROM seen)")(lambda t: pov.mask_events(t("story_events").where("chat_id = 'FURNITURE'").select("id", "message_index"), _uni(t)).select("id"))
