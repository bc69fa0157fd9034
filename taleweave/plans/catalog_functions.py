"""Scalar, vector, text, array and map functions over whole tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import english, random
from ..functions import relevance as R
from ..functions import text as X
from ..functions import vector as V
from ..operators import postings, state
from ..sources import chat
from .registry import query

# Checking SQL for a few shared pieces.
NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
DASH = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
TOKENS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
STEM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, 'ies$', 'i'), 'sses$', 'ss'), 'ied$', 'i'), '(ing|ed|ly|ness|ion|ions|ful|er|est|s)$', '')"
FILLERS = "[" + ", ".join(f"'{w}'" for w in X.FILLER_WORDS) + "]"
STOPS = "[" + ", ".join(f"'{w}'" for w in X.QUERY_STOP_WORDS) + "]"
MEANINGFUL = f"list_filter(regexp_split_to_array(trim(regexp_replace(lower({{0}}), '[^a-z]+', ' ', 'g')), '\\s+'), lambda w: w <> '' AND NOT list_contains({FILLERS}, w))"
TRIGRAMS = f"list_distinct(flatten(list_transform(list_transform({TOKENS}, lambda w: '  ' || w || ' '), lambda p: list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)))))"
#: A few words of the synthetic texts stand in for the lexicons, which are the caller's.
STATES, ACCEPTED, EMOTIONS, AROUSAL = ["the", "tion", "and"], ["of", "the"], ["thea", "onea", "her"], {"thea": 0.8, "onea": 0.2}
_list = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
KEY = "concat(p_type, '''s ', p_brand, '-state')"


def _one(name: str, table: str, key: str, value, sql: str, where: str = "true") -> None:
    """A function of one row: key and value for every row of a table."""
    query(name, f"SELECT {key} AS k, {sql} AS v FROM {table} WHERE {where}")(lambda t: t(table).where(where).select(F.expr(key).alias("k"), value(t).alias("v")))


_one("fn_norm_name", "part", "p_partkey", lambda t: X.norm_name(F.concat(F.lit("  "), F.upper("p_name"), F.lit("  X "))), NORM.format("concat('  ', upper(p_name), '  X ')"))
_one("fn_slug", "part", "p_partkey", lambda t: X.slug(F.concat("p_name", F.lit(" #"), "p_brand")), "'chr-' || " + DASH.format("concat(p_name, ' #', p_brand)"))
_one("fn_loc_slug", "nation", "n_nationkey", lambda t: X.location_slug("n_name"), "'loc-' || " + DASH.format("n_name"))
_one("fn_chat_scoped_id", "customer", "c_custkey", lambda t: X.chat_scoped_id("c_name", "c_mktsegment"), "'chr-' || substr(sha1(c_mktsegment), 1, 6) || '-' || " + DASH.format("c_name"))
_one("fn_content_id", "documents", "doc_id", lambda t: X.content_id("evt", "text"), "'evt-' || substr(sha1(text), 1, 16)")
_one(
    "fn_fallback_ids", "customer", "c_custkey", lambda t: F.array_join(X.fallback_ids("c_name", F.array("c_mktsegment", F.lit(""), "c_mktsegment", F.lit("x"))), "|"),
    f"'chr-' || {DASH.format('c_name')} || '|' || 'chr-' || substr(sha1(c_mktsegment), 1, 6) || '-' || {DASH.format('c_name')} || '|' || 'chr-' || substr(sha1('x'), 1, 6) || '-' || {DASH.format('c_name')}",
)
_one(
    "fn_ws_key", "part", "p_partkey", lambda t: X.state_key(F.expr(KEY.replace("'''s '", "\"'s \""))),
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(" + KEY + ")), '[''’]s\\b', 's', 'g'), '[^\\w\\s_-]', '', 'g'), '[\\s\\-]+', '_', 'g'), '_(status|state)$', ''), '_+', '_', 'g'), '^_+|_+$', '', 'g')",
)
_one(
    "fn_is_snapshot_key", "part", "p_partkey", lambda t: X.is_snapshot_key(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("ship", "worship", "north pursuit", "cargo-hold")]), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit(" "), F.when(F.col("p_size") > 25, F.lit("")).otherwise(F.col("p_type")))),
    "CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN p_size > 25 ELSE true END",
)
_one("fn_approx_stem", "part", "p_partkey", lambda t: X.approx_stem(F.lower(F.col("p_name"))), STEM.format("lower(p_name)"))
_one("fn_meaningful", "documents", "doc_id", lambda t: F.array_join(X.meaningful_words("text"), " "), f"array_to_string({MEANINGFUL.format('text')}, ' ')")
_one(
    "fn_transient", "conversations", "conv_id * 100 + turn", lambda t: X.is_transient("text", STATES),
    f"coalesce(len({MEANINGFUL.format('text')}) <= 4 AND (list_contains({_list(STATES)}, {STEM.format('(' + MEANINGFUL.format('text') + ')[1]')}) OR list_contains({_list(STATES)}, ({MEANINGFUL.format('text')})[1])), false)",
)
query(
    "fn_disposition",
    f"""WITH w AS (SELECT doc_id, lang, {MEANINGFUL.format('text')}[1] AS f FROM documents), s AS (SELECT *, {STEM.format('f')} AS st FROM w)
    SELECT doc_id, CASE WHEN lang <> 'en' OR f IS NULL THEN 'verify' WHEN f IN ('of', 'the') OR st IN ('of', 'the') THEN 'accept'
      WHEN f IN ('thea', 'onea', 'her') OR st IN ('thea', 'onea', 'her') THEN
        CASE coalesce(CASE f WHEN 'thea' THEN 0.8 WHEN 'onea' THEN 0.2 END, CASE st WHEN 'thea' THEN 0.8 WHEN 'onea' THEN 0.2 END, 1.0) >= 0.55 WHEN true THEN 'reject' ELSE 'verify' END
      ELSE 'verify' END AS v FROM s""",
)(lambda t: t("documents").select("doc_id", X.disposition("text", F.when(F.col("lang") == "en", F.lit("personality")).otherwise(F.col("lang")), ACCEPTED, EMOTIONS, AROUSAL).alias("v")))
_one("fn_norm_content", "documents", "doc_id", lambda t: X.norm_content("text"), "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')")
query("fn_tsvector", f"""WITH {english.lexemes_sql('documents', 'doc_id', 'text')} SELECT d.doc_id, md5(coalesce(v, '')) AS v FROM documents d LEFT JOIN
    (SELECT id, string_agg(chr(39) || stem || chr(39) || ':' || p, ' ' ORDER BY stem) AS v FROM (SELECT id, stem, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS p FROM lexemes GROUP BY id, stem) x GROUP BY id) y ON y.id = d.doc_id""")(
    lambda t: t("documents").select("doc_id", F.md5(postings.vector_text(postings.postings("text"))).alias("v"))
)
query("fn_tsvector_simple", f"SELECT doc_id, md5(array_to_string({TOKENS.format('text')}, ' ')) AS v FROM documents")(lambda t: t("documents").select("doc_id", F.md5(F.array_join(X.tokens("text"), " ")).alias("v")))
_one(
    "fn_or_tsquery", "benchmark", "item_id", lambda t: F.array_join(F.array_sort(X.query_terms("text")), " | "),
    f"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({STOPS}, w)))), ' | ')",
)
query(
    "fn_chunk",
    "SELECT doc_id, CAST(i AS INT) AS chunk, substr(text, i * 1600 + 1, 2000) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(1 + greatest(ceil((length(text) - 2000) / 1600.0), 0) AS BIGINT))) AS i FROM documents) x",
)(lambda t: t("documents").select("doc_id", F.posexplode(X.chunks("text")).alias("chunk", "piece")))
_one(
    "fn_quotes", "documents", "doc_id", lambda t: F.array_join(X.quotes(F.concat(F.lit('say "'), "source", F.lit('" and “'), "lang", F.lit("” "), "text")), "|"),
    """array_to_string(list_filter(list_transform(regexp_extract_all(concat('say "', source, '" and “', lang, '” ', text), '["“]([^"“”\\n]{4,400})["”]', 1), lambda x: trim(x)), lambda x: length(x) >= 4), '|')""",
)
_one(
    "fn_strip_meta", "pages", "page_id", lambda t: F.md5(X.strip_blocks("html", ("script", "style"))),
    "md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script>.*?</script>', ' ', 'g'), '(?is)<script>.*$', ' '), '(?is)<style>.*?</style>', ' ', 'g'), '(?is)<style>.*$', ' '), '\\s+', ' ', 'g')))",
)
_one("fn_sentiment", "events", "event_id", lambda t: X.sentiment_label(F.col("value") % 2 - 1), "CASE WHEN value % 2 - 1 >= 0.7 THEN 'very positive' WHEN value % 2 - 1 >= 0.3 THEN 'positive' WHEN value % 2 - 1 >= -0.3 THEN 'neutral' WHEN value % 2 - 1 >= -0.7 THEN 'negative' ELSE 'very negative' END")
_LORE = "CASE WHEN regexp_matches(x, '\\b(race|species|class|ability|magic|spell|skill)\\b') THEN 'lore' WHEN regexp_matches(x, '\\b(secret|hidden|unknown|forbidden|only .* knows)\\b') THEN 'secret' WHEN regexp_matches(x, '\\b(rule|law|custom|tradition|taboo|must|always|never)\\b') THEN 'rule' WHEN regexp_matches(x, '\\b(born|childhood|past|history|origin|backstory|used to)\\b') THEN 'backstory' ELSE 'lore' END"
_WORD = "(['secret', 'old law', 'history', 'plain', 'magic secret'])[CAST(doc_id % 5 AS INT) + 1]"
_extra = lambda: F.element_at(X.strings(["secret", "old law", "history", "plain", "magic secret"]), (F.col("doc_id") % 5 + 1).cast("int"))
query("fn_lore_domain", f"SELECT doc_id, {_LORE} AS v FROM (SELECT doc_id, lower(concat({_WORD}, ' ', source, ' ', text)) AS x FROM documents) y")(
    lambda t: t("documents").select("doc_id", X.lore_domain(_extra(), F.array("source"), F.col("text")).alias("v"))
)
_PERSON = "regexp_matches(lower(text), '\\b(he|she|they|his|her|their|personality|appearance|age|hair|eyes)\\b')"
_PLACE = "regexp_matches(lower(concat(text, CASE WHEN doc_id % 3 = 0 THEN ' a village' ELSE '' END)), '\\b(located|situated|lies|stands|built|area|region|place|land|realm|city|town|village|forest|mountain|castle|tavern|temple)\\b')"
_NAMED = "length({0}) < 40 AND {0} <> '' AND NOT regexp_matches({0}, '(?i)^(the|a|an|about|info|note)')"
query(
    "fn_lore_char_loc",
    f"""SELECT doc_id, CASE WHEN {_PERSON} AND {_NAMED.format('c')} THEN c END AS person, CASE WHEN {_PLACE} THEN CASE WHEN {_NAMED.format('c')} THEN c WHEN length(source) < 40 AND source <> '' THEN source END END AS place
    FROM (SELECT doc_id, text, source, {_WORD} AS c FROM documents) x""",
)(
    lambda t: t("documents").select(
        "doc_id", X.lore_character(_extra(), "text").alias("person"),
        X.lore_location(_extra(), F.array("source"), F.concat("text", F.when(F.col("doc_id") % 3 == 0, " a village").otherwise(""))).alias("place"),
    )
)
_one("fn_template", "documents", "doc_id", lambda t: F.md5(X.fill_template(F.concat(F.lit("{{User}} and {{CHAR}}: "), "text"))), "md5(concat('(user) and (character): ', text))")
query(
    "fn_mode_user",
    "SELECT chat_id, name FROM (SELECT chat_id, name, row_number() OVER (PARTITION BY chat_id ORDER BY count(*) DESC, min(message_index)) AS r FROM messages WHERE is_user OR name = 'assistant' GROUP BY chat_id, name) x WHERE r = 1",
)(
    lambda t: t("messages").where("is_user OR name = 'assistant'").groupBy("chat_id", F.trim("name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("message_index").alias("first"))
    .groupBy("chat_id").agg(F.max_by("name", F.struct("n", -F.col("first"))).alias("name"))
)
_one("fn_is_persona", "characters", "id", lambda t: F.exists(F.array("name", "alias"), lambda x: F.lower(F.trim(x)) == F.lit("customer#000000007")), "lower(trim(name)) = 'customer#000000007' OR lower(trim(alias)) = 'customer#000000007'")
_one("fn_mention_wb", "documents", "doc_id", lambda t: X.mentions(F.col("text"), F.lit("then")), "regexp_matches(text, '(?i)\\bthen\\b')")
_one("fn_event_text", "story_events", "id", lambda t: X.event_text("summary", F.when(F.col("significance") > 2, F.col("source_text"))), "substr(CASE WHEN significance > 2 THEN summary || chr(10) || chr(10) || source_text ELSE summary END, 1, 8000)")
query(
    "fn_snap_text",
    "SELECT s.id, substr(concat_ws(chr(10), s.summary, 'tone: ' || s.tone, 'present: ' || string_agg(c.name, ', ' ORDER BY c.name)), 1, 8000) AS v FROM snapshots s LEFT JOIN snapshot_chars c ON c.snapshot_id = s.id GROUP BY s.id, s.summary, s.tone",
)(
    lambda t: t("snapshots").alias("s").join(t("snapshot_chars").groupBy(F.col("snapshot_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("present")), "id", "left")
    .select("id", X.snapshot_text("summary", "tone", F.coalesce("present", F.expr("cast(array() as array<string>)"))).alias("v"))
)
_one("fn_trait_text", "traits", "id", lambda t: X.trait_text("character_id", "content", F.when(F.col("id") % 2 == 0, F.col("category"))), "character_id || ' is ' || content || CASE WHEN id % 2 = 0 THEN ': ' || category ELSE '' END")
_one("fn_alias_entry", "traits", "id", lambda t: X.alias_entry("content", F.when(F.col("id") % 2 == 0, F.col("category"))), "content || CASE WHEN id % 2 = 0 THEN ': ' || category ELSE '' END")
_one("fn_chat_label", "conversations", "conv_id * 100 + turn", lambda t: X.chat_label(F.concat("role", F.lit(" - "), "conv_id", F.lit(".jsonl"))), "split_part(regexp_replace(concat(role, ' - ', conv_id, '.jsonl'), '\\.jsonl$', ''), ' - ', 1)")
query("fn_desc_join", "SELECT character_id, string_agg(content, '; ' ORDER BY id) AS v FROM traits WHERE content <> '' GROUP BY character_id")(
    lambda t: t("traits").groupBy("character_id").agg(F.array_sort(F.collect_list(F.struct("id", "content"))).alias("c")).select("character_id", X.description_of(F.transform("c", lambda x: x["content"])).alias("v"))
)
query("fn_tone_merge", "SELECT s.id, concat_ws(' | ', s.tone, string_agg(c.name || ': present', ' | ' ORDER BY c.name)) AS v FROM snapshots s LEFT JOIN snapshot_chars c ON c.snapshot_id = s.id GROUP BY s.id, s.tone")(
    lambda t: t("snapshots").join(t("snapshot_chars").groupBy(F.col("snapshot_id").alias("id")).agg(F.array_sort(F.collect_list(F.concat("name", F.lit(": present")))).alias("f")), "id", "left")
    .select("id", X.merge_tone("tone", F.coalesce("f", F.expr("cast(array() as array<string>)"))).alias("v"))
)
query(
    "fn_siblings",
    "SELECT a.snapshot_id, a.character_id, string_agg(DISTINCT lower(b.name), '|' ORDER BY lower(b.name)) AS v FROM snapshot_chars a JOIN snapshot_chars b ON b.snapshot_id = a.snapshot_id AND b.name <> a.name GROUP BY a.snapshot_id, a.character_id",
)(
    lambda t: t("snapshot_chars").join(t("snapshot_chars").groupBy("snapshot_id").agg(F.collect_set(F.lower("name")).alias("all")), "snapshot_id")
    .select("snapshot_id", "character_id", F.array_join(F.array_sort(F.array_except("all", F.array(F.lower("name")))), "|").alias("v")).where("v <> ''")
)
_one("fn_stale_tag", "world_state", "id", lambda t: X.stale_tag(F.col("value"), F.lit(40) - F.col("source_message_index")), "CASE WHEN 40 - source_message_index >= 15 THEN value || ' [stale: not seen in ' || (40 - source_message_index) || ' turns]' ELSE value END")
_one("fn_template_title", "story_events", "id", lambda t: X.arc_title("super", "source_text"), "'Super Arc: ' || substr(source_text, 1, 80)")
_one("fn_node_label", "story_events", "id", lambda t: F.substring("source_text", 1, 60), "substr(source_text, 1, 60)")
_one("fn_lore_keys", "pages", "page_id", lambda t: X.file_date(F.concat(F.lit("log 2024-01-"), F.col("page_id") % 28 + 1, F.lit(".jsonl"))), "concat('2024-01-', page_id % 28 + 1)")
query(
    "fn_node_style",
    """WITH d AS (SELECT character_id, count(*) AS n FROM participated GROUP BY character_id)
    SELECT character_id, round(least(55, 20 + ln(n + 1) * 6), 6) AS size, '#b8c8e0' AS colour FROM d""",
)(lambda t: t("participated").groupBy("character_id").agg(F.count(F.lit(1)).alias("n")).select("character_id", F.round(F.least(F.lit(55.0), 20 + F.log(F.col("n") + 1) * 6), 6).alias("size"), F.lit("#b8c8e0").alias("colour")))
_one("src_item_date", "documents", "doc_id", lambda t: X.file_date(F.concat(F.lit("chat - 2023/"), F.col("doc_id") % 12 + 1, F.lit("/7.jsonl"))), "concat('2023/', doc_id % 12 + 1, '/7')")
_one("src_active_swipe", "conversations", "conv_id * 100 + turn", lambda t: F.coalesce(F.nullif(F.get(F.array("role", F.lit(""), "text"), F.col("turn").cast("int")), F.lit("")), "text"), "coalesce(nullif(CASE turn WHEN 0 THEN role WHEN 1 THEN '' WHEN 2 THEN text END, ''), text)")
query("src_batch", "SELECT chat_id, CAST(floor(message_index / 3) * 3 AS INT) AS batch, count(*) AS n, string_agg(name, ',' ORDER BY message_index) AS names FROM messages GROUP BY ALL")(
    lambda t: chat.batches(t("messages"), 3).select("chat_id", "batch", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: m["name"]), ",").alias("names"))
)
query("src_corpus", "SELECT chat_id, md5(string_agg('[' || name || ']: ' || mes, chr(10) || chr(10) ORDER BY message_index)) AS v FROM messages WHERE NOT is_system GROUP BY chat_id")(
    lambda t: chat.corpus(t("messages")).select("chat_id", F.md5("corpus").alias("v"))
)
_one(
    "src_llm_json", "events", "event_id", lambda t: F.get_json_object(F.get(X.json_candidates(F.concat(F.lit("Sure:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))), F.lit(1)), "$.k"),
    "json_extract_string(props, '$.k')",
)
_one("fn_clamp_sig", "story_events", "id", lambda t: F.least(F.lit(5), F.greatest(F.lit(1), F.round(F.coalesce(F.nullif(F.col("significance"), F.lit(3)) * 1.5, F.lit(3.0))).cast("int"))), "CAST(least(5, greatest(1, round(coalesce(nullif(significance, 3) * 1.5, 3)))) AS INT)")
_one("fn_score_clamp", "answers", "question_id || model || cond", lambda t: F.least(F.lit(2), F.greatest(F.lit(0), F.col("score") * 2 - 1)), "least(2, greatest(0, score * 2 - 1))")
_one("fn_coalesce_merge", "items", "id", lambda t: F.coalesce(F.nullif(F.when(F.col("significance") > 3, F.col("name")).otherwise(""), F.lit("")), "owner_id"), "CASE WHEN significance > 3 THEN name ELSE owner_id END")
_one("fn_greatest", "items", "id", lambda t: F.greatest("significance", F.lit(3)), "greatest(significance, 3)")
_one("fn_interval", "world_state", "id", lambda t: F.col("valid_from") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS"), "valid_from < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 24 HOUR")

# vectors
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def query_vector(t) -> list[float]:
    return t("embeddings").where("vec_id = 0").select("embedding").first()[0]


_one("fn_cosine", "embeddings", "vec_id", lambda t: F.round(V.cosine_to(F.col("embedding"), query_vector(t)), 6), f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[])), 6)")
_one("fn_norm", "embeddings", "vec_id", lambda t: F.round(V.norm(F.col("embedding")), 6), "round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6)")
query("fn_vec_parse", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 4) AS first, 0.0::DOUBLE AS last, len(embedding) + 1 AS n FROM embeddings")(
    lambda t: t("embeddings").select("vec_id", V.parse(F.concat(F.lit("["), F.array_join(F.transform(V.doubles("embedding"), lambda x: x.cast("string")), ","), F.lit(", nan?]"))).alias("p"))
    .select("vec_id", F.round(F.get("p", F.lit(0)), 4).alias("first"), F.element_at("p", -1).alias("last"), F.size("p").cast("long").alias("n"))
)
query("fn_avg_vector", "WITH p AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings) SELECT label, i - 1 AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS v FROM p GROUP BY label, i")(
    lambda t: V.mean_vectors(t("embeddings"), "label").select("label", F.posexplode("centroid").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))
)
_J = "CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))::DOUBLE ELSE 0 END"
_AW, _BW = f"list_distinct({TOKENS.format('a.text')})", f"list_distinct({TOKENS.format('b.text')})"
query("fn_jaccard", f"SELECT a.doc_id, round({_J.format(_AW, _BW)}, 6) AS v FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")(
    lambda t: t("documents").select("doc_id", F.array_distinct(X.tokens("text")).alias("a")).join(t("documents").select((F.col("doc_id") - 1).alias("doc_id"), F.array_distinct(X.tokens("text")).alias("b")), "doc_id").select("doc_id", F.round(V.jaccard(F.col("a"), F.col("b")), 6).alias("v"))
)
_T = "(SELECT text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))"
_TR = TRIGRAMS.format("text"), TRIGRAMS.format(_T)


def first_text(t) -> str:
    return t("benchmark").orderBy("item_id").select("text").first()[0]


_one("fn_trgm", "benchmark", "item_id", lambda t: F.round(R.trigram_similarity("text", F.lit(first_text(t))), 6), f"round(len(list_intersect({_TR[0]}, {_TR[1]})) / len(list_distinct(list_concat({_TR[0]}, {_TR[1]})))::DOUBLE, 6)")
query("fn_trgm_match", f"SELECT item_id FROM benchmark WHERE round(len(list_intersect({_TR[0]}, {_TR[1]})) / len(list_distinct(list_concat({_TR[0]}, {_TR[1]})))::DOUBLE, 9) >= 0.3")(
    lambda t: t("benchmark").where(F.round(R.trigram_similarity("text", F.lit(first_text(t))), 9) >= R.TRIGRAM_MATCH).select("item_id")
)
TERMS = ["the", "tion", "thea", "onan"]
LEXEMES = english.query_lexemes(["edsts", "tioning", "thea", "onan", "the", "hations"])
_LEX = english.lexemes_sql("documents", "doc_id", "text")
_OWN = ", ".join(f"'{x}'" for x in LEXEMES)
query("fn_ts_rank", f"""WITH {_LEX} SELECT d.doc_id, round(coalesce(v, 0) * (0.1 / 1.64493406685) / {len(LEXEMES)}, 6) AS v FROM documents d LEFT JOIN
    (SELECT id, sum(list_sum(list_transform(range(1, n + 1), lambda j: 1.0::DOUBLE / (j * j)))) AS v FROM (SELECT id, stem, count(*) AS n FROM lexemes WHERE stem IN ({_OWN}) GROUP BY id, stem) x GROUP BY id) y ON y.id = d.doc_id""")(
    lambda t: t("documents").select("doc_id", F.round(postings.or_rank(english.times_of("text", LEXEMES)), 6).alias("v"))
)
query("fn_ts_match", f"WITH {_LEX} SELECT DISTINCT id AS doc_id FROM lexemes WHERE stem IN ({_OWN})")(
    lambda t: t("documents").where(F.exists(english.times_of("text", LEXEMES), lambda n: n > 0)).select("doc_id")
)
query("fn_ts_phrase", f"WITH {_LEX} SELECT DISTINCT a.id FROM lexemes a JOIN lexemes b ON b.id = a.id AND b.pos = a.pos + 1 WHERE a.stem = '{english.stem('tion')}' AND b.stem = '{english.stem('thea')}'")(
    lambda t: postings.phrase(postings.build(t("documents").select(F.col("doc_id").alias("id"), "text"), "text", ["id"]), ["tion", "thea"], ("id",))
)
query("fn_ts_headline")(lambda t: t("documents").select("doc_id", english.headline("text", LEXEMES).alias("v")))
_one("fn_rrf", "story_events", "id", lambda t: F.round(R.reciprocal(F.col("message_index") + 1), 9), "round(1.0::DOUBLE / (60 + message_index + 1), 9)")
query("fn_recency", "SELECT id, round(0.003 * message_index / CAST(max(message_index) OVER (PARTITION BY chat_id) AS DOUBLE), 9) AS v FROM story_events")(
    lambda t: t("story_events").join(t("story_events").groupBy("chat_id").agg(F.max("message_index").alias("top")), "chat_id").select("id", F.round(R.RECENCY * F.col("message_index") / F.col("top"), 9).alias("v"))
)

# arrays and maps
query("arr_any", "SELECT id FROM memory WHERE chat_id IN ('src:src1', 'src:src2')")(lambda t: t("memory").where(F.col("chat_id").isin("src:src1", "src:src2")).select("id"))
query("arr_unnest_exists", "SELECT id FROM characters WHERE alias LIKE '%7' OR lower(name) LIKE '%7'")(lambda t: t("characters").where(F.exists(F.array("alias", F.lower("name")), lambda x: x.endswith("7"))).select("id"))
query("arr_union_distinct", "SELECT id, CASE WHEN lower(name) = alias THEN alias || '|' || name ELSE alias || '|' || name END AS v FROM characters")(
    lambda t: t("characters").select("id", F.array_join(F.array_distinct(F.filter(F.concat(F.array("alias", F.lit(" ")), F.array("name", "alias")), lambda x: F.trim(x) != "")), "|").alias("v"))
)
query("arr_replace_dedup", "SELECT snapshot_id, string_agg(DISTINCT CASE WHEN character_id LIKE 'chr-c%' THEN 'chr-c' ELSE character_id END, '|' ORDER BY CASE WHEN character_id LIKE 'chr-c%' THEN 'chr-c' ELSE character_id END) AS v FROM snapshot_chars GROUP BY snapshot_id")(
    lambda t: t("snapshot_chars").groupBy("snapshot_id").agg(F.collect_list("character_id").alias("a")).select("snapshot_id", F.array_join(F.array_sort(F.array_distinct(F.transform("a", lambda x: F.when(x.startswith("chr-c"), "chr-c").otherwise(x)))), "|").alias("v"))
)
query("arr_append", "SELECT id, content || '|' || category AS v FROM traits")(lambda t: t("traits").select("id", F.array_join(F.array_append(F.array("content"), F.col("category")), "|").alias("v")))
query("arr_card", "SELECT s.id, count(c.character_id) AS v FROM snapshots s LEFT JOIN snapshot_chars c ON c.snapshot_id = s.id GROUP BY s.id")(
    lambda t: t("snapshots").join(t("snapshot_chars").groupBy(F.col("snapshot_id").alias("id")).agg(F.collect_list("character_id").alias("a")), "id", "left").select("id", F.size(F.coalesce("a", F.expr("cast(array() as array<string>)"))).cast("long").alias("v"))
)
query("arr_lateral", "SELECT s.id, c.character_id FROM snapshots s LEFT JOIN snapshot_chars c ON c.snapshot_id = s.id")(
    lambda t: t("snapshots").join(t("snapshot_chars").groupBy(F.col("snapshot_id").alias("id")).agg(F.collect_list("character_id").alias("a")), "id", "left").select("id", F.explode_outer("a").alias("character_id"))
)
query("arr_zip_unnest", "SELECT label, vec_id FROM embeddings")(
    lambda t: t("embeddings").groupBy("label").agg(F.collect_list("vec_id").alias("v"), F.collect_list("label").alias("l")).select(F.explode(F.arrays_zip("l", "v")).alias("z")).select(F.col("z.l").alias("label"), F.col("z.v").alias("vec_id"))
)
query("arr_flatten_names", "SELECT v, min(o) AS first FROM (SELECT name AS v, 2 * significance AS o FROM characters UNION ALL SELECT alias, 2 * significance + 1 FROM characters) x GROUP BY v ORDER BY first, v LIMIT 50")(
    lambda t: t("characters").select("significance", F.posexplode(F.array("name", "alias")).alias("p", "v")).groupBy("v").agg(F.min(2 * F.col("significance") + F.col("p")).alias("first")).orderBy("first", "v").limit(50)
)
query("map_ws_snapshot", "SELECT chat_id, string_agg(key || '=' || value, ';' ORDER BY key) AS v FROM world_state WHERE valid_until IS NULL GROUP BY chat_id")(
    lambda t: t("world_state").where("valid_until IS NULL").groupBy("chat_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("m"))
    .select("chat_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("v"))
)
query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")(
    lambda t: t("events").select("event_id", F.coalesce(F.from_json("props", "persistent_k int, k int")["persistent_k"], F.from_json("props", "k int")["k"]).alias("k"))
)

_one("fn_item_slug", "part", "p_partkey", lambda t: X.item_slug("p_name"), "'item-' || " + DASH.format("p_name"))
query("fn_lore_char", f"SELECT doc_id, CASE WHEN {_PERSON} AND {_NAMED.format('c')} THEN c END AS v FROM (SELECT doc_id, text, {_WORD} AS c FROM documents) x")(lambda t: t("documents").select("doc_id", X.lore_character(_extra(), "text").alias("v")))
query("fn_lore_loc", f"SELECT doc_id, CASE WHEN {_PLACE} THEN CASE WHEN {_NAMED.format('c')} THEN c WHEN length(source) < 40 AND source <> '' THEN source END END AS v FROM (SELECT doc_id, text, source, {_WORD} AS c FROM documents) x")(
    lambda t: t("documents").select("doc_id", X.lore_location(_extra(), F.array("source"), F.concat("text", F.when(F.col("doc_id") % 3 == 0, " a village").otherwise(""))).alias("v"))
)
query("fn_stem_content", f"""WITH {english.lexemes_sql('traits', 'id', 'content')} SELECT t.id, coalesce(v, '') AS v FROM traits t LEFT JOIN (SELECT id, string_agg(DISTINCT stem, ' ' ORDER BY stem) AS v FROM lexemes GROUP BY id) x ON x.id = t.id""")(
    lambda t: t("traits").select("id", F.array_join(F.array_sort(F.array_distinct(english.analysed("content")["terms"])), " ").alias("v"))
)
_one(
    "fn_stem_approx", "traits", "id", lambda t: F.array_join(F.array_sort(F.array_distinct(F.transform(X.meaningful_words("content"), lambda w: X.approx_stem(w)))), " "),
    f"array_to_string(list_sort(list_distinct(list_transform({MEANINGFUL.format('content')}, lambda w: {STEM.format('w')}))), ' ')",
)
_one("fn_redact", "customer", "c_custkey", lambda t: X.redacted(F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))), "CASE WHEN c_custkey % 3 <> 0 THEN 'set:' || substr(c_name, 1, 4) || '…' END")
query("src_embed")(lambda t: t("benchmark").select("item_id", V.embed_text("text").alias("embedding")))
query("fn_prng")(lambda t: t.spark.createDataFrame((lambda draw: [(i, draw()) for i in range(10)])(random.Mulberry32(42)), "k int, v double"))
query("src_sample_chunks")(lambda t: t.spark.createDataFrame(chat.sample_chunks(t("documents").orderBy(F.length("text").desc(), "doc_id").select("text").first()[0], 5), "start int, piece string"))
query("rd_config", "SELECT c_name AS name, coalesce(m, 'persistent') AS mode FROM (SELECT c_name, CASE WHEN c_custkey % 10 = 0 THEN 'readonly' END AS m FROM customer) x")(
    lambda t: t("customer").select(F.col("c_name").alias("name"), F.coalesce(F.when(F.col("c_custkey") % 10 == 0, "readonly"), F.lit("persistent")).alias("mode"))
)
query("up_arc_link", "SELECT arc_id, event_id FROM arc_events")(lambda t: state.insert_new(t("arc_events").where("position < 3"), t("arc_events"), ["arc_id", "event_id"]).select("arc_id", "event_id"))
