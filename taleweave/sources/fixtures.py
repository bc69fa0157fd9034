"""The story tables derived from the synthetic tables, so that every operator runs at any scale factor.

Each is one SELECT in the SQL that both Spark and the checking engine read; `oracle` prefixes a checking
query with those it names.  Spark numbers the rows of a chat in stretches of its order, with the same numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ADAPTERS = {
    "messages": """SELECT concat('conv-', conv_id) AS chat_id, CAST(turn AS INT) AS message_index, role AS name, role = 'user' AS is_user,
        role = 'system' AS is_system, text AS mes FROM conversations""",
    "vec_count": "SELECT count(*) AS n_vec FROM embeddings",
    "memory": """SELECT d.doc_id AS id, concat('src:', d.source) AS chat_id, 'message' AS node_type, CAST(d.doc_id AS STRING) AS node_id,
        CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS INT) AS message_index, d.text AS content, d.text AS raw_text,
        e.embedding FROM documents d CROSS JOIN vec_count c JOIN embeddings e ON e.vec_id = d.doc_id % c.n_vec""",
    "characters": """SELECT concat('chr-c', c_custkey) AS id, c_name AS name, lower(c_name) AS alias, CAST(1 + c_custkey % 5 AS INT) AS significance FROM customer
        UNION ALL SELECT concat('chr-s', s_suppkey), s_name, lower(s_name), CAST(1 + s_suppkey % 5 AS INT) FROM supplier""",
    "locations": "SELECT concat('loc-', n.n_nationkey) AS id, n.n_name AS name, r.r_name AS parent FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey",
    "brands": """SELECT l.l_orderkey AS orderkey, min(p.p_brand) AS first_brand, max(p.p_brand) AS last_brand FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY l.l_orderkey""",
    "story_events": """SELECT concat('evt-', o.o_orderkey) AS id, o.o_orderkey AS orderkey, o.o_custkey AS custkey, c.c_mktsegment AS chat_id,
        CAST(row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY o.o_orderdate, o.o_orderkey) - 1 AS INT) AS message_index,
        6 - CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS significance, concat('loc-', c.c_nationkey) AS location_id, o.o_orderdate AS ts,
        concat(o.o_orderpriority, ' order ', o.o_orderkey) AS summary,
        concat(o.o_orderpriority, ' order ', o.o_orderkey, ' ', coalesce(b.first_brand, ''), ' ', coalesce(b.last_brand, '')) AS source_text,
        CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING) END AS world_time
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN brands b ON b.orderkey = o.o_orderkey""",
    "event_vectors": "SELECT s.id, s.chat_id, s.message_index, s.significance, s.summary, e.embedding FROM story_events s CROSS JOIN vec_count c JOIN embeddings e ON e.vec_id = s.message_index % c.n_vec",
    "participated": """SELECT concat('chr-c', custkey) AS character_id, id AS event_id FROM story_events
        UNION SELECT concat('chr-s', l.l_suppkey), concat('evt-', l.l_orderkey) FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "feels": """SELECT concat('chr-c', o.o_custkey) AS from_id, concat('chr-s', l.l_suppkey) AS to_id, c.c_mktsegment AS session_id,
        round(avg(CAST(CASE l.l_returnflag WHEN 'R' THEN -1.0 WHEN 'A' THEN 0.5 ELSE 1.0 END AS DOUBLE)), 6) AS sentiment, round(avg(l.l_discount) * 10, 6) AS intensity
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY o.o_custkey, l.l_suppkey, c.c_mktsegment""",
    "items": """SELECT concat('itm-', l.l_partkey) AS id, min(p.p_name) AS name, concat('chr-s', min(l.l_suppkey)) AS owner_id, concat('loc-', min(s.s_nationkey)) AS location_id,
        min(c.c_mktsegment) AS chat_id, CAST(1 + l.l_partkey % 5 AS INT) AS significance FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
        JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY l.l_partkey""",
    "chains": """SELECT from_id, to_id, 'causal' AS chain_type FROM (SELECT id AS from_id, lead(id) OVER (PARTITION BY custkey ORDER BY ts, orderkey) AS to_id FROM story_events) x WHERE to_id IS NOT NULL""",
    "arc_events": """SELECT concat('arc-', chat_id, '-', substr(CAST(ts AS STRING), 1, 7)) AS arc_id, id AS event_id,
        CAST(row_number() OVER (PARTITION BY chat_id, substr(CAST(ts AS STRING), 1, 7) ORDER BY message_index) - 1 AS INT) AS position FROM story_events""",
    "story_arcs": """SELECT concat('arc-', chat_id, '-', substr(CAST(ts AS STRING), 1, 7)) AS id, chat_id, 1 AS hierarchy_level, concat('sup-', chat_id, '-', substr(CAST(min(ts) AS STRING), 1, 4)) AS parent_arc_id,
        max(significance) AS importance, min(message_index) AS start_idx, max(message_index) AS end_idx FROM story_events GROUP BY chat_id, substr(CAST(ts AS STRING), 1, 7)
        UNION ALL SELECT concat('sup-', chat_id, '-', substr(CAST(ts AS STRING), 1, 4)), chat_id, 0, NULL, max(significance), min(message_index), max(message_index) FROM story_events GROUP BY chat_id, substr(CAST(ts AS STRING), 1, 4)""",
    "present_at": """SELECT character_id, location_id, chat_id, message_index, row_number() OVER (PARTITION BY character_id, chat_id ORDER BY message_index DESC, event_id) = 1 AS is_current
        FROM (SELECT p.character_id, p.event_id, e.location_id, e.chat_id, e.message_index FROM participated p JOIN story_events e ON e.id = p.event_id) x""",
    "snapshots": """SELECT concat('ctx-', s.chat_id, '-', s.message_index) AS id, s.chat_id, s.message_index, s.summary, s.location_id, s.id AS event_id,
        CASE WHEN s.significance >= 4 THEN 'tense' ELSE 'calm' END AS tone, e.embedding
        FROM story_events s CROSS JOIN vec_count c JOIN embeddings e ON e.vec_id = s.message_index % c.n_vec WHERE s.message_index % 20 = 0""",
    "snapshot_chars": "SELECT s.id AS snapshot_id, s.chat_id, s.message_index, c.id AS character_id, c.name FROM snapshots s JOIN participated p ON p.event_id = s.event_id JOIN characters c ON c.id = p.character_id",
    "facts": """SELECT concat('fact-', substr(sha1(lower(d.text)), 1, 16)) AS id, min(d.text) AS content,
        min(CASE WHEN l.toxic = 1 THEN 'secret' WHEN l.quality = 0 THEN 'backstory' ELSE 'knowledge' END) AS domain
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY sha1(lower(d.text))""",
    "knows": """SELECT DISTINCT d.source AS character_id, concat('fact-', substr(sha1(lower(d.text)), 1, 16)) AS fact_id, d.lang AS chat_id
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "traits": """SELECT d.doc_id AS id, d.source AS character_id, d.lang AS category, d.text AS content, concat('t', d.doc_id % 4) AS source_chat,
        CASE WHEN d.doc_id % 5 = 4 THEN d.doc_id - 4 END AS canonical_id, d.doc_id % 7 AS merged_count, e.embedding
        FROM documents d CROSS JOIN vec_count c JOIN embeddings e ON e.vec_id = d.doc_id % c.n_vec""",
    "plot_threads": """SELECT concat('plot-', orderkey) AS id, e.chat_id, e.summary AS title, e.significance AS importance, o.o_orderstatus AS status,
        CASE WHEN o.o_orderstatus = 'F' THEN e.message_index END AS resolved_at, e.message_index AS planted_at FROM story_events e JOIN orders o ON o.o_orderkey = e.orderkey""",
    "plot_characters": "SELECT concat('plot-', orderkey) AS plot_id, concat('chr-c', custkey) AS character_id FROM story_events",
    "quotes": """SELECT concat('q-', conv_id, '-', turn) AS id, concat('conv-', conv_id) AS chat_id, CAST(turn AS INT) AS message_index, role AS speaker, text AS quote FROM conversations""",
    "state_stream": """SELECT event_id, concat('u', user_id) AS chat_id, event_type AS key, CAST(value AS STRING) AS value, ts AS valid_from,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS source_message_index FROM events""",
    "world_state": """SELECT event_id AS id, chat_id, key, value, valid_from, lead(valid_from) OVER (PARTITION BY chat_id, key ORDER BY valid_from, event_id) AS valid_until,
        source_message_index FROM state_stream""",
    "ingestion": "SELECT concat('conv-', conv_id) AS chat_id, CASE WHEN count(*) > 2 THEN 'done' ELSE 'pending' END AS status, count(*) AS messages_total FROM conversations GROUP BY conv_id",
    "models": "SELECT 0 AS model_ord, 'strong' AS model UNION ALL SELECT 1, 'mid' UNION ALL SELECT 2, 'cheap'",
    "conditions": "SELECT 0 AS cond_ord, 'raw-16k-only' AS cond UNION ALL SELECT 1, 'raw-32k-only' UNION ALL SELECT 2, 'raw-16k-memory' UNION ALL SELECT 3, 'raw-32k-memory'",
    "answers": """SELECT b.item_id AS question_id, m.model, c.cond, CAST((b.item_id * 7 + m.model_ord * 3 + c.cond_ord) % 3 AS INT) AS score, length(b.text) AS context_chars,
        CASE WHEN c.cond_ord >= 2 THEN CAST((b.item_id * 131) % 4000 AS INT) ELSE 0 END AS memory_block_chars, CASE WHEN (b.item_id + c.cond_ord) % 17 = 0 THEN 'timeout' END AS error
        FROM benchmark b CROSS JOIN models m CROSS JOIN conditions c""",
}
_NAME = re.compile(r"\b(" + "|".join(sorted([*ADAPTERS, *RAW], key=len, reverse=True)) + r")\b")
_TABLE = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(sorted([*ADAPTERS, *RAW], key=len, reverse=True)) + r")\b")
_PLACE = re.compile(r"CAST\(row_number\(\) OVER \([^)]*\) - 1 AS INT\) AS message_index,")
#: Rows that are numbered within a chat: by which columns, and the stretch of that order that is sorted at a time.
NUMBERED = {"story_events": (["ts", "orderkey"], "to_date(ts)"), "memory": (["id"], "id div 65536")}


def numbered(rows: DataFrame, by: list[str], stretch: str) -> DataFrame:
    """Adds message_index, a row's place in its chat from 0: its place in its stretch, after the counts of the stretches before.

    No task sorts a whole chat.  stretch: an expression that never falls in that order.
    """
    rows = rows.withColumn("_s", F.expr(stretch))
    before = F.sum("_n").over(Window.partitionBy("_c").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(F.col("chat_id").alias("_c"), F.col("_s").alias("_t")).agg(F.count(F.lit(1)).alias("_n")).select("_c", "_t", F.coalesce(before, F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy("chat_id", "_s").orderBy(*by))
    placed = rows.withColumn("_r", own).join(counts, F.col("chat_id").eqNullSafe(F.col("_c")) & F.col("_s").eqNullSafe(F.col("_t")))
    return placed.withColumn("message_index", (F.col("_b") + F.col("_r") - 1).cast("int"))


#: Columns that need a join of their own, and the parts of the table's SQL that go with them.
EXTRA = {"story_events": ("source_text", [r"concat\([^()]*coalesce\(b\.first_brand, ''\)[^()]*coalesce\(b\.last_brand, ''\)\) AS source_text,", r"LEFT JOIN brands b ON b\.orderkey = o\.o_orderkey"])}


def lean(tables, name: str) -> DataFrame:
    """A table without the columns that need a join of their own, which Spark would run unread; of other tables than `Tables`, the table."""
    return tables.lean(name) if isinstance(tables, Tables) else tables(name)


class Tables:
    """Raw and derived tables of one folder by name; each is built once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._known, self._given = spark, folder, {}, frozenset()

    def __call__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in RAW:
                self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in NUMBERED:
                self._known[name] = self._numbered(name, ADAPTERS[name])
            else:
                self._known[name] = self._derived(ADAPTERS[name])
        return self._known[name]

    def _numbered(self, name: str, sql: str) -> DataFrame:
        columns = self.sql(sql).columns
        return numbered(self.sql(_PLACE.sub("", sql)), *NUMBERED[name]).select(*columns)

    def lean(self, name: str) -> DataFrame:
        """The table without its columns in `EXTRA`."""
        if name not in EXTRA:
            return self(name)
        column, parts = EXTRA[name]
        if name in self._given:
            return self(name).drop(column)
        if (key := f"{name} without {column}") not in self._known:
            sql = ADAPTERS[name]
            for part in parts:
                sql, n = re.subn(part, "", sql)
                assert n == 1, part
            self._known[key] = self._numbered(name, sql)
        return self._known[key]

    def keeping(self, **frames: DataFrame) -> Tables:
        """The folder's tables with some of them given; those derived from these follow."""
        out = Tables(self.spark, self.folder)
        out._known |= frames
        out._given = frozenset(frames)
        return out

    def sql(self, text: str) -> DataFrame:
        return self._with(text, self)

    def _derived(self, text: str) -> DataFrame:
        """A table of `ADAPTERS`, which name the columns they read."""
        return self._with(text, lambda n: self(n) if n not in EXTRA or EXTRA[n][0] in text else self.lean(n))

    def _with(self, text: str, table) -> DataFrame:
        used = {m[1] for m in _TABLE.findall(text)}
        return self.spark.sql(_TABLE.sub(lambda m: f"{m[1]} {{{m[2]}}}", text), **{n: table(n) for n in used})


def oracle(text: str) -> str:
    """The query with the derived tables that it needs in front."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for n in dict.fromkeys(_NAME.findall(sql)):
            if n in ADAPTERS and n not in needed and re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql):
                visit(ADAPTERS[n])
                needed.append(n)

    visit(text)
    # a table that stands in the WITH list more than once would be named twice
    needed = list(dict.fromkeys(needed))
    if not needed:
        return text
    heads = ",\n".join(f"{n} AS ({ADAPTERS[n]})" for n in needed)
    body = text.lstrip()
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}{heads},\n{body[m.end():]}"
    return f"WITH {heads}\n{body}"
