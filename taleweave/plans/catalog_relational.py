"""Filters, joins, aggregates, windows and set operations in the forms that the story tables need."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import arcs, cells, evaluation, graph, naming, search, traits
from . import catalog_functions as functions
from ..sources.fixtures import lean
from .registry import query

W = Window
one = "*"


def _last(c: str):
    return F.col(c).desc_nulls_last()


# filters and projections
query("flt_scope", "SELECT id FROM memory WHERE chat_id IN ('src:src3')")(lambda t: t("memory").where(F.col("chat_id").isin(["src:src3"])).select("id"))
query("flt_current", "SELECT id, key, value FROM world_state WHERE valid_until IS NULL")(lambda t: t("world_state").where(F.col("valid_until").isNull()).select("id", "key", "value"))
query("flt_null_cap", "SELECT id FROM plot_threads WHERE resolved_at IS NULL OR resolved_at <= 500")(lambda t: t("plot_threads").where(F.col("resolved_at").isNull() | (F.col("resolved_at") <= 500)).select("id"))
query("flt_prune_cols", "SELECT id, chat_id, message_index FROM memory")(lambda t: t("memory").select("id", "chat_id", "message_index"))
query("flt_like", "SELECT id FROM story_arcs WHERE id LIKE 'arc-%' AND id NOT LIKE 'arc-MACH%'")(lambda t: t("story_arcs").where(F.col("id").startswith("arc-") & ~F.col("id").startswith("arc-MACH")).select("id"))
query("flt_min_msg", "SELECT chat_id, message_index FROM messages WHERE NOT is_system AND length(name || ': ' || mes) >= 80")(
    lambda t: t("messages").where(~F.col("is_system") & (F.length(F.concat("name", F.lit(": "), "mes")) >= 80)).select("chat_id", "message_index")
)
query("flt_attrib_guard", "SELECT id FROM traits WHERE NOT (category <> 'en' AND regexp_matches(content, '(?i)\\bde\\b') AND NOT regexp_matches(content, '(?i)\\ble\\b'))")(
    lambda t: traits.attributed(t("traits").withColumns({"siblings": F.array(F.lit("de"), F.lit("d")), "own": F.array(F.lit("le"))}), F.col("category") != "en", "content").select("id")
)
query("flt_valid_edges", "SELECT from_id, to_id FROM feels WHERE from_id IN (SELECT id FROM characters WHERE significance > 2) AND to_id IN (SELECT id FROM characters WHERE significance > 2)")(
    lambda t: t("feels").join(t("characters").where("significance > 2").select(F.col("id").alias("from_id")), "from_id", "left_semi").join(t("characters").where("significance > 2").select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id")
)
query("flt_visible_types", "SELECT id FROM plot_threads WHERE status IN ('O', 'P')")(lambda t: t("plot_threads").where(F.col("status").isin("O", "P")).select("id"))
query("flt_search_label", "SELECT id, name FROM characters WHERE contains(lower(name), '00042')")(lambda t: t("characters").where(F.lower("name").contains("00042")).select("id", "name"))
query("flt_mem_list", "SELECT id, message_index FROM memory WHERE chat_id = 'src:src1' ORDER BY message_index DESC, id")(lambda t: t("memory").where("chat_id = 'src:src1'").orderBy(_last("message_index"), "id").select("id", "message_index"))

# joins
query("jn_inner_2x", "SELECT f.from_id, a.name AS from_name, b.name AS to_name, f.intensity FROM feels f JOIN characters a ON a.id = f.from_id JOIN characters b ON b.id = f.to_id WHERE f.session_id = 'BUILDING'")(
    lambda t: t("feels").where("session_id = 'BUILDING'").alias("f").join(t("characters").alias("a"), F.col("a.id") == F.col("f.from_id")).join(t("characters").alias("b"), F.col("b.id") == F.col("f.to_id")).select("f.from_id", F.col("a.name").alias("from_name"), F.col("b.name").alias("to_name"), "f.intensity")
)
query("jn_left_dim", "SELECT s.id, l.name FROM snapshots s LEFT JOIN locations l ON l.id = s.location_id")(lambda t: t("snapshots").alias("s").join(t("locations").alias("l"), F.col("l.id") == F.col("s.location_id"), "left").select("s.id", "l.name"))
query("jn_left_chain", "SELECT e.id, coalesce(string_agg(c.name, ',' ORDER BY c.name), '') AS names FROM story_events e LEFT JOIN participated p ON p.event_id = e.id LEFT JOIN characters c ON c.id = p.character_id GROUP BY e.id")(
    lambda t: t("story_events").select("id").join(t("participated").withColumnRenamed("event_id", "id"), "id", "left").join(t("characters").select(F.col("id").alias("character_id"), "name"), "character_id", "left").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
)
query("jn_semi", "SELECT id FROM facts f WHERE EXISTS (SELECT 1 FROM knows k WHERE k.fact_id = f.id AND k.chat_id = 'en')")(lambda t: t("facts").join(t("knows").where("chat_id = 'en'").select(F.col("fact_id").alias("id")), "id", "left_semi").select("id"))
query("jn_anti", "SELECT id FROM facts f WHERE NOT EXISTS (SELECT 1 FROM knows k WHERE k.fact_id = f.id AND k.character_id = 'src1')")(lambda t: t("facts").join(t("knows").where("character_id = 'src1'").select(F.col("fact_id").alias("id")), "id", "left_anti").select("id"))
query("jn_not_in", "SELECT id FROM facts WHERE id NOT IN (SELECT fact_id FROM knows WHERE character_id IN ('src1', 'src2')) AND domain <> 'knowledge'")(
    lambda t: t("facts").where("domain <> 'knowledge'").join(t("knows").where(F.col("character_id").isin("src1", "src2")).select(F.col("fact_id").alias("id")), "id", "left_anti").select("id")
)
query("jn_cross", "SELECT c.id AS target, f.id AS fact_id FROM locations c CROSS JOIN facts f WHERE f.domain = 'secret'")(lambda t: t("facts").where("domain = 'secret'").select(F.col("id").alias("fact_id")).crossJoin(t("locations").select(F.col("id").alias("target"))))
query("jn_self_offset", "SELECT a.event_id, b.event_id AS other FROM arc_events a JOIN arc_events b ON b.arc_id = a.arc_id AND b.position IN (a.position - 1, a.position + 1)")(
    lambda t: t("arc_events").select("arc_id", "event_id", F.explode(F.array(F.col("position") - 1, F.col("position") + 1)).alias("position")).join(t("arc_events").withColumnRenamed("event_id", "other"), ["arc_id", "position"]).select("event_id", "other")
)
query("jn_range", "SELECT a.chat_id, a.message_index, count(*) AS around, CAST(sum(length(b.mes)) AS BIGINT) AS chars FROM messages a JOIN messages b ON b.chat_id = a.chat_id AND b.message_index BETWEEN a.message_index - 4 AND a.message_index + 4 GROUP BY a.chat_id, a.message_index")(
    lambda t: t("messages").select("chat_id", "message_index", *[f.over(W.partitionBy("chat_id").orderBy("message_index").rangeBetween(-4, 4)).alias(n) for f, n in ((F.count(F.lit(1)), "around"), (F.sum(F.length("mes")), "chars"))])
)
query("jn_theta_name", "SELECT DISTINCT q.c_custkey AS k, c.id FROM customer q JOIN characters c ON lower(c.name) = lower(q.c_name) OR c.alias = lower(q.c_name)")(
    lambda t: t("customer").select(F.col("c_custkey").alias("k"), F.lower("c_name").alias("form")).join(t("characters").select("id", F.explode(F.array(F.lower("name"), "alias")).alias("form")).distinct(), "form").select("k", "id").distinct()
)
query("jn_theta_contain", "SELECT n.n_name AS q, r.r_name AS name FROM nation n JOIN region own ON own.r_regionkey = n.n_regionkey JOIN region r ON length(r.r_name) >= 4 AND (contains(lower(n.n_name || ' of ' || own.r_name), lower(r.r_name)) OR contains(lower(r.r_name), lower(n.n_name)))")(
    lambda t: t("nation").join(t("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("n_name", "r_name").select(F.col("n_name").alias("q"), F.concat("n_name", F.lit(" of "), "r_name").alias("text"), "r_name")
    .join(t("region").select(F.col("r_name").alias("name")), (F.length("name") >= 4) & (F.lower("text").contains(F.lower("name")) | F.lower("name").contains(F.lower("q")))).select("q", "name").distinct()
)
query("jn_mentions", "SELECT DISTINCT e.id, c.id AS name_id FROM story_events e JOIN (SELECT DISTINCT concat('b-', p_brand) AS id, p_brand AS name FROM part UNION ALL SELECT concat('o-', o_orderpriority), substr(o_orderpriority, 3) FROM orders GROUP BY o_orderpriority) c ON length(c.name) >= 2 AND regexp_matches(e.source_text, '(?i)(^|[^A-Za-z0-9_])' || regexp_escape(c.name) || '($|[^A-Za-z0-9_])')")(
    lambda t: naming.mentioned_in(t("story_events").select("id", F.col("source_text").alias("text")), t("part").select(F.concat(F.lit("b-"), "p_brand").alias("name_id"), F.col("p_brand").alias("name")).distinct().unionByName(
        t("orders").select(F.concat(F.lit("o-"), "o_orderpriority").alias("name_id"), F.substring("o_orderpriority", 3, 100).alias("name")).distinct()))
)
#: Cells of the vector index, and how many a query probes: 0.9 of the ten nearest on the synthetic vectors, which hardly cluster.
CELLS, PROBES = 32, 20


def _knn(t, probed: int):
    rows = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    centers = cells.fit(rows, CELLS)
    return cells.knn_join(rows.where("id % 50 = 0").select(F.col("id").alias("query"), "embedding"), cells.with_cell(rows, centers), centers, 10, probed)


query("jn_knn_cells", """SELECT query, id, similarity FROM (SELECT q.vec_id AS query, r.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 9) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 9) DESC, r.vec_id) AS k FROM embeddings q CROSS JOIN embeddings r WHERE q.vec_id % 50 = 0) x WHERE k <= 10""")(
    lambda t: _knn(t, CELLS)
)
query("jn_knn_probed")(lambda t: _knn(t, PROBES))
query("jn_compound", "SELECT DISTINCT p.character_id, e.id FROM present_at p JOIN story_events e ON e.location_id = p.location_id AND e.chat_id = p.chat_id WHERE p.is_current AND p.character_id LIKE 'chr-s%1'")(
    lambda t: t("present_at").where(F.col("is_current") & F.col("character_id").like("chr-s%1")).select("character_id", "location_id", "chat_id").distinct().join(lean(t, "story_events").select("id", "location_id", "chat_id"), ["location_id", "chat_id"]).select("character_id", "id")
)
query(
    "jn_knn",
    """SELECT a_id, b_id, rank FROM (SELECT a.id AS a_id, b.id AS b_id, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.id) AS rank
    FROM traits a JOIN traits b ON b.character_id = a.character_id AND b.category = a.category AND b.id <> a.id) x WHERE rank <= 3""",
)(lambda t: traits.nearest(t("traits"), t("traits"), 3).select("a_id", "b_id", "rank"))
query("jn_update_from", "SELECT e.id, coalesce(n.v, e.significance) AS significance FROM story_events e LEFT JOIN (SELECT event_id AS id, position % 5 AS v FROM arc_events WHERE position < 10) n ON n.id = e.id")(
    lambda t: t("story_events").select("id", "significance").join(t("arc_events").where("position < 10").select(F.col("event_id").alias("id"), (F.col("position") % 5).alias("v")), "id", "left").select("id", F.coalesce("v", "significance").alias("significance"))
)
query("jn_delete_using", "SELECT p.character_id, p.event_id FROM participated p WHERE p.event_id NOT IN (SELECT id FROM story_events WHERE chat_id = 'BUILDING')")(
    lambda t: t("participated").join(t("story_events").where("chat_id = 'BUILDING'").select(F.col("id").alias("event_id")), "event_id", "left_anti").select("character_id", "event_id")
)
query("jn_in_subq", "SELECT character_id, event_id FROM participated WHERE event_id IN (SELECT id FROM story_events WHERE message_index = 7)")(lambda t: t("participated").join(t("story_events").where("message_index = 7").select(F.col("id").alias("event_id")), "event_id", "left_semi").select("character_id", "event_id"))
query("jn_hydrate", "SELECT 'event' AS kind, id FROM story_events WHERE id IN (SELECT event_id FROM participated WHERE character_id = 'chr-s1') UNION ALL SELECT 'item', id FROM items WHERE owner_id = 'chr-s1'")(
    lambda t: t("story_events").join(t("participated").where("character_id = 'chr-s1'").select(F.col("event_id").alias("id")), "id", "left_semi").select(F.lit("event").alias("kind"), "id").unionByName(t("items").where("owner_id = 'chr-s1'").select(F.lit("item").alias("kind"), "id"))
)
query("jn_label_map", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")(lambda t: t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality")))

# aggregates
query("ag_max_idx", "SELECT greatest(coalesce((SELECT max(message_index) FROM memory WHERE chat_id = 'src:src1'), 0), coalesce((SELECT max(message_index) FROM story_events WHERE chat_id = 'BUILDING'), 0)) AS top")(
    lambda t: search.top_index([t("memory").where("chat_id = 'src:src1'"), t("story_events").where("chat_id = 'BUILDING'")])
)
query("ag_array_filter", "SELECT chat_id, string_agg(world_time, ',' ORDER BY world_time) AS v FROM story_events WHERE world_time IS NOT NULL GROUP BY chat_id")(
    lambda t: t("story_events").groupBy("chat_id").agg(F.array_join(F.array_sort(F.collect_list("world_time")), ",").alias("v"))
)
query("ag_array_distinct", "SELECT chat_id, string_agg(DISTINCT lower(name), ',' ORDER BY lower(name)) AS v FROM snapshot_chars s WHERE message_index IN (SELECT message_index FROM snapshots x WHERE x.chat_id = s.chat_id ORDER BY message_index DESC LIMIT 3) GROUP BY chat_id")(
    lambda t: t("snapshots").select("chat_id", "id", F.row_number().over(W.partitionBy("chat_id").orderBy(_last("message_index"))).alias("r")).where("r <= 3").join(t("snapshot_chars").select(F.col("snapshot_id").alias("id"), "name"), "id").groupBy("chat_id").agg(F.array_join(F.sort_array(F.collect_set(F.lower(F.trim("name")))), ",").alias("v"))
)
query("ag_count_filter", "SELECT count(*) AS n, count(*) FILTER (canonical_id IS NULL) AS canonical, count(*) FILTER (merged_count > 3) AS merged FROM traits")(
    lambda t: t("traits").agg(F.count(one).alias("n"), F.count_if(F.col("canonical_id").isNull()).alias("canonical"), F.count_if(F.col("merged_count") > 3).alias("merged"))
)
query("ag_scalar_subq", "SELECT c.id, (SELECT count(*) FROM participated p WHERE p.character_id = c.id) AS events, (SELECT count(*) FROM feels f WHERE f.from_id = c.id) AS feels FROM characters c")(
    lambda t: t("characters").select("id").join(t("participated").groupBy(F.col("character_id").alias("id")).agg(F.count(one).alias("events")), "id", "left").join(t("feels").groupBy(F.col("from_id").alias("id")).agg(F.count(one).alias("feels")), "id", "left").na.fill(0)
)
query("ag_group_having", "SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY lower(p_name) HAVING count(*) >= 2")(lambda t: t("part").groupBy(F.lower("p_name").alias("name")).agg(F.count(one).alias("n")).where("n >= 2"))
query("ag_top1_group", "SELECT arc_id, name FROM (SELECT a.arc_id, c.name, row_number() OVER (PARTITION BY a.arc_id ORDER BY count(*) DESC, c.name) AS r FROM arc_events a JOIN participated p ON p.event_id = a.event_id JOIN characters c ON c.id = p.character_id GROUP BY a.arc_id, c.name) x WHERE r = 1")(
    lambda t: arcs.protagonists(t("arc_events"), t("participated"), t("characters")).select("arc_id", "name")
)
query("ag_recency_max", "SELECT character_id, max(i) AS last FROM (SELECT p.character_id, e.message_index AS i FROM participated p JOIN story_events e ON e.id = p.event_id UNION ALL SELECT character_id, message_index FROM snapshot_chars) x GROUP BY character_id")(
    lambda t: t("participated").join(t("story_events").select(F.col("id").alias("event_id"), "message_index"), "event_id").select("character_id", "message_index").unionByName(t("snapshot_chars").select("character_id", "message_index")).groupBy("character_id").agg(F.max("message_index").alias("last"))
)
query("ag_chat_rollup", "SELECT chat_id, CAST(max(n) AS BIGINT) AS messages FROM (SELECT chat_id, messages_total AS n FROM ingestion UNION ALL SELECT chat_id, count(*) FROM story_events GROUP BY chat_id) x GROUP BY chat_id")(
    lambda t: t("ingestion").select("chat_id", F.col("messages_total").alias("n")).unionByName(t("story_events").groupBy("chat_id").agg(F.count(one).alias("n"))).groupBy("chat_id").agg(F.max("n").alias("messages"))
)
query("ag_mode", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) x WHERE r = 1")(
    lambda t: t("events").groupBy("user_id", "event_type").agg(F.count(one).alias("n")).groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("m")).select("user_id", "m.event_type")
)
query("ag_count", "SELECT chat_id, count(*) AS n FROM story_events GROUP BY chat_id")(lambda t: t("story_events").groupBy("chat_id").agg(F.count(one).alias("n")))
query("ag_avg_vec", "WITH p AS (SELECT character_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM traits WHERE category = 'en') SELECT character_id, round(sum(v * v), 6) AS size FROM (SELECT character_id, i, avg(CAST(x AS DOUBLE)) AS v FROM p GROUP BY character_id, i) y GROUP BY character_id")(
    lambda t: V.mean_vectors(t("traits").where("category = 'en'"), "character_id").select("character_id", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x), 6).alias("size"))
)
query("ag_degree", "SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM feels UNION ALL SELECT to_id FROM feels) x GROUP BY id")(
    lambda t: graph.degrees(t("feels").select("from_id", "to_id"))
)
_SPINE = "row_number() OVER (PARTITION BY a.arc_id ORDER BY e.significance DESC, e.message_index, e.id)"
query("ag_community", f"SELECT arc_id, max(CASE WHEN r = 1 THEN id END) AS spine, count(*) AS n, min(message_index) AS first, max(message_index) AS last FROM (SELECT a.arc_id, e.id, e.message_index, {_SPINE} AS r FROM arc_events a JOIN story_events e ON e.id = a.event_id) x GROUP BY arc_id")(
    lambda t: arcs.describe(t("arc_events").select(F.col("arc_id").alias("community"), F.col("event_id").alias("id")).join(t("story_events"), "id")).select(F.col("community").alias("arc_id"), "spine", F.col("size").alias("n"), "first", "last")
)
query("ag_modularity", """WITH e AS (SELECT from_id AS a, to_id AS b, intensity AS w FROM feels WHERE intensity > 0), c AS (SELECT id, significance AS c FROM characters),
    tot AS (SELECT c, sum(w) AS t FROM (SELECT c.c, e.w FROM e JOIN c ON c.id = e.a UNION ALL SELECT c.c, e.w FROM e JOIN c ON c.id = e.b) x GROUP BY c),
    ins AS (SELECT x.c, sum(e.w) AS i FROM e JOIN c x ON x.id = e.a JOIN c y ON y.id = e.b AND y.c = x.c GROUP BY x.c), m AS (SELECT sum(w) AS m FROM e)
    SELECT round(sum(coalesce(i, 0) / m - 0.5 * (t / (2 * m)) * (t / (2 * m))), 6) AS q FROM tot LEFT JOIN ins ON ins.c = tot.c CROSS JOIN m""")(
    lambda t: arcs.modularity(t("feels").where("intensity > 0").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("intensity").alias("w")), t("characters").select("id", F.col("significance").alias("community")), 0.5)
)
query("ag_eval", "SELECT model, cond, round(avg(score), 6) AS mean, round((count(*) FILTER (score = 2) + 0.5 * count(*) FILTER (score = 1)) / count(*), 6) AS accuracy, count(*) FILTER (score = 2) AS full_marks, count(*) FILTER (score = 1) AS part, count(*) FILTER (score = 0) AS wrong FROM answers GROUP BY model, cond")(
    lambda t: evaluation.report(t("answers"))
)
query("ag_winrate", "SELECT a.model, a.cond, count(*) FILTER (a.score > coalesce(b.score, 0)) AS wins, count(*) FILTER (a.score = coalesce(b.score, 0)) AS ties, count(*) FILTER (a.score < coalesce(b.score, 0)) AS losses FROM answers a LEFT JOIN answers b ON b.question_id = a.question_id AND b.model = a.model AND b.cond = 'raw-16k-only' WHERE a.cond <> 'raw-16k-only' GROUP BY a.model, a.cond")(
    lambda t: evaluation.win_rates(t("answers"), "raw-16k-only")
)
query("ag_blocksize", "SELECT cond, round(avg(memory_block_chars), 6) AS mean_chars, count(error) AS errors FROM answers GROUP BY cond")(lambda t: t("answers").groupBy("cond").agg(F.round(F.avg("memory_block_chars"), 6).alias("mean_chars"), F.count("error").alias("errors")))
query("ag_overlap", """SELECT child, parent, n FROM (SELECT c.arc_id AS child, s.id AS parent, count(*) AS n, row_number() OVER (PARTITION BY c.arc_id ORDER BY count(*) DESC, s.id) AS r
    FROM arc_events c JOIN story_events e ON e.id = c.event_id JOIN story_arcs s ON s.hierarchy_level = 0 AND s.chat_id = e.chat_id AND e.message_index BETWEEN s.start_idx AND s.end_idx GROUP BY c.arc_id, s.id) x WHERE r = 1""")(
    lambda t: arcs.parents(
        t("arc_events").select(F.col("arc_id").alias("child"), "event_id"),
        t("story_events").alias("e").join(t("story_arcs").where("hierarchy_level = 0").alias("s"), (F.col("s.chat_id") == F.col("e.chat_id")) & F.col("e.message_index").between(F.col("s.start_idx"), F.col("s.end_idx"))).select(F.col("s.id").alias("parent"), F.col("e.id").alias("event_id")),
    )
)

# windows, sorts, top-k
query("wn_rownum_dedup", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY chat_id, key ORDER BY valid_from DESC, id DESC) AS r FROM world_state) x WHERE r = 1")(
    lambda t: t("world_state").groupBy("chat_id", "key").agg(F.max(F.struct("valid_from", "id")).alias("m")).select("m.id")
)
query("wn_distinct_on_msg", "SELECT DISTINCT ON (chat_id, message_index) chat_id, message_index, id FROM memory ORDER BY chat_id, message_index, node_type, id")(lambda t: t("memory").groupBy("chat_id", "message_index").agg(F.min(F.struct("node_type", "id")).alias("m")).select("chat_id", "message_index", "m.id"))
query("wn_distinct_on_name", "SELECT DISTINCT ON (p_type) p_type, p_partkey FROM part ORDER BY p_type, length(p_name) DESC, p_partkey")(
    lambda t: t("part").groupBy("p_type").agg(F.min(F.struct((-F.length("p_name")).alias("l"), "p_partkey")).alias("m")).select("p_type", "m.p_partkey")
)
query("wn_distinct_on_rel", "SELECT DISTINCT ON (to_id) to_id, session_id, intensity FROM feels WHERE from_id = 'chr-c7' ORDER BY to_id, session_id DESC")(
    lambda t: t("feels").where("from_id = 'chr-c7'").groupBy("to_id").agg(F.max(F.struct("session_id", "intensity")).alias("m")).select("to_id", "m.session_id", "m.intensity")
)
query("wn_rank_source", "SELECT id, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY significance DESC, id) - 1 AS INT) AS rank FROM story_events")(lambda t: t("story_events").select("id", (F.row_number().over(W.partitionBy("chat_id").orderBy(F.desc("significance"), "id")) - 1).alias("rank")))
query("wn_cap_kind", "SELECT id FROM (SELECT id, score, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS r FROM (SELECT id, o_orderstatus AS kind, significance AS score FROM story_events e JOIN orders o ON o.o_orderkey = e.orderkey) x) y WHERE r <= 8 ORDER BY score DESC, id LIMIT 20")(
    lambda t: search.cap_kinds(t("story_events").join(t("orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("kind")), "orderkey").select("id", "kind", F.col("significance").alias("score")), {"O": 8, "F": 8, "P": 8}, 20, ["id"]).select("id")
)
query("wn_take_per_char", "SELECT character_id, fact_id FROM (SELECT character_id, fact_id, row_number() OVER (PARTITION BY character_id ORDER BY fact_id) AS r FROM knows) x WHERE r <= 10")(
    lambda t: t("knows").withColumn("r", F.row_number().over(W.partitionBy("character_id").orderBy("fact_id"))).where("r <= 10").select("character_id", "fact_id")
)
query("wn_first_per_turn", "SELECT chat_id, message_index, min(id) AS id FROM memory GROUP BY chat_id, message_index")(lambda t: t("memory").groupBy("chat_id", "message_index").agg(F.min("id").alias("id")))
query("wn_traits_per_cat", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY character_id, category ORDER BY merged_count DESC, id) AS r FROM traits) x WHERE r <= 8")(
    lambda t: t("traits").withColumn("r", F.row_number().over(W.partitionBy("character_id", "category").orderBy(F.desc("merged_count"), "id"))).where("r <= 8").select("id")
)
query("wn_arc_position", "SELECT arc_id, event_id, position FROM arc_events")(
    lambda t: t("story_events").withColumn("arc_id", F.concat(F.lit("arc-"), "chat_id", F.lit("-"), F.substring(F.col("ts").cast("string"), 1, 7))).select("arc_id", F.col("id").alias("event_id"), (F.row_number().over(W.partitionBy("arc_id").orderBy("message_index")) - 1).alias("position"))
)
query("wn_arc_prev_next", "SELECT event_id, lag(event_id) OVER (PARTITION BY arc_id ORDER BY position) AS before, lead(event_id) OVER (PARTITION BY arc_id ORDER BY position) AS after FROM arc_events")(
    lambda t: t("arc_events").select("event_id", F.lag("event_id").over(W.partitionBy("arc_id").orderBy("position")).alias("before"), F.lead("event_id").over(W.partitionBy("arc_id").orderBy("position")).alias("after"))
)
query("wn_ttl_age", "SELECT id, 200 - source_message_index AS age FROM world_state WHERE valid_until IS NULL AND 200 - source_message_index > 12")(lambda t: t("world_state").where("valid_until IS NULL").select("id", (200 - F.col("source_message_index")).alias("age")).where("age > 12"))


def _top(name: str, table: str, order: str, cols: str, n: int, where: str = "true") -> None:
    keys = [k.split() for k in order.split(", ")]
    sort = lambda: [F.col(k[0]).desc_nulls_last() if k[1:] == ["DESC"] else F.col(k[0]).asc_nulls_last() for k in keys]
    sql = ", ".join(f"{k[0]} {'DESC' if k[1:] else 'ASC'} NULLS LAST" for k in keys)
    query(name, f"SELECT {cols} FROM {table} WHERE {where} ORDER BY {sql} LIMIT {n}")(lambda t: t(table).where(where).orderBy(*sort()).limit(n).select(*cols.split(", ")))


_top("tk_relations", "feels", "intensity DESC, from_id, to_id", "from_id, to_id, intensity", 20, "session_id = 'BUILDING'")
_top("tk_state", "world_state", "valid_from DESC, id DESC", "id, key, value", 20, "valid_until IS NULL")
_top("tk_threads", "plot_threads", "importance DESC, id", "id, importance", 20, "resolved_at IS NULL AND chat_id = 'BUILDING'")
_top("tk_snapshots", "snapshots", "message_index DESC, id", "id, message_index", 3, "chat_id = 'BUILDING'")
_top("tk_boost", "story_events", "significance DESC, message_index DESC, id", "id, significance, message_index", 30, "chat_id = 'BUILDING'")
_top("tk_persona", "traits", "merged_count DESC, category, content, id", "id, merged_count", 40, "character_id = 'src1'")
query("tk_entities", "SELECT character_id, max(message_index) AS last FROM present_at WHERE chat_id = 'BUILDING' GROUP BY character_id ORDER BY last DESC, character_id LIMIT 50")(
    lambda t: t("present_at").where("chat_id = 'BUILDING'").groupBy("character_id").agg(F.max("message_index").alias("last")).orderBy(F.desc("last"), "character_id").limit(50)
)
query("tk_knn", "SELECT id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 9) AS similarity FROM memory ORDER BY similarity DESC, id LIMIT 10")(
    lambda t: search.nearest(t("memory"), functions.query_vector(t), 10).select("id", "similarity")
)
query("sr_timeline", "SELECT id, world_time FROM story_events WHERE chat_id = 'BUILDING' ORDER BY world_time IS NULL, world_time, message_index LIMIT 100")(
    lambda t: t("story_events").where("chat_id = 'BUILDING'").orderBy(F.col("world_time").isNull(), "world_time", "message_index").limit(100).select("id", "world_time")
)
_top("sr_recent", "story_events", "message_index DESC, ts DESC, id", "id, message_index", 20, "custkey = 7")

# set operations
query("so_union_dedup", "SELECT character_id, event_id FROM participated UNION SELECT p.character_id, e.id FROM present_at p JOIN story_events e ON e.location_id = p.location_id AND e.chat_id = p.chat_id AND e.message_index = p.message_index")(
    lambda t: t("participated").select("character_id", "event_id").union(t("present_at").join(t("story_events").select(F.col("id").alias("event_id"), "location_id", "chat_id", "message_index"), ["location_id", "chat_id", "message_index"]).select("character_id", "event_id")).distinct()
)
query("so_union_all_traits", "SELECT id, 'chat' AS pool FROM traits WHERE source_chat = 't1' UNION ALL SELECT id, 'persona' FROM traits WHERE character_id = 'src1'")(
    lambda t: t("traits").where("source_chat = 't1'").select("id", F.lit("chat").alias("pool")).unionByName(t("traits").where("character_id = 'src1'").select("id", F.lit("persona").alias("pool")))
)
query("so_union_refs", "SELECT id, count(*) AS refs FROM (SELECT location_id AS id FROM story_events UNION ALL SELECT location_id FROM items UNION ALL SELECT location_id FROM snapshots) x GROUP BY id")(
    lambda t: t("story_events").select(F.col("location_id").alias("id")).unionByName(t("items").select(F.col("location_id").alias("id"))).unionByName(t("snapshots").select(F.col("location_id").alias("id"))).groupBy("id").agg(F.count(one).alias("refs"))
)
query("so_set_diff", "SELECT DISTINCT chat_id, message_index + 1 AS i FROM snapshots WHERE (chat_id, message_index + 1) NOT IN (SELECT chat_id, message_index FROM snapshots)")(
    lambda t: t("snapshots").select("chat_id", (F.col("message_index") + 1).alias("i")).distinct().join(t("snapshots").select("chat_id", F.col("message_index").alias("i")), ["chat_id", "i"], "left_anti")
)
