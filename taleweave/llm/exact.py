"""Exact dedup through a minimal perfect hash over the distinct digests already seen.

The digest of a text is the SHA-256 of its characters without white space.  `build_index` keeps, for every
distinct digest, its winner (the row with the most code points, then the smallest doc_id) and the number of
rows, and packs them by shard: a minimal perfect hash (levels of bit arrays, a key's slot being the rank of
the first bit that it alone sets) and slots that hold the full digest and the winner's locator.  `lookup`
sends digests, never texts, to their shard, reads the slot and compares all 32 bytes: a member gets its
winner, any other digest gets none.

`dedup` of a table by itself takes the rows whose id hashes even as its history.  The other rows' distinct
digests are looked up there: members are repeats, whose bests and counts go into the history's slots
(`update`); nonmembers are grouped separately, into an index of their own.  Then each row asks for its winner.
With a given history, its winners stay and their repeats go.

A digest that a third of all rows share meets in no single task: distinct digests take partial aggregates,
and rows that ask a large shard are salted over copies of that shard (a shard is of bounded size).  Ids
keep their type and value: they pass through Arrow, never through floating point.

Defined results: a null or empty text, or one of white space only, has the digest of the empty text; repeated
rows, also of one id, are copies of each other, and one row of each digest is kept; a null doc_id comes last
in ties, and is the keep_id where no copy has an id; a text may be of any length, as only its digest moves; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, durable, join_small, without

#: Digests in a shard of the index, and rows in a look-up group.
SHARD_KEYS, GROUP_ROWS = 20_000, 20_000
GAMMA = 2.0


class PerfectHash:
    """Levels of bit arrays over keys given as pairs of 64-bit numbers."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @staticmethod
    def place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        x = a + b * np.uint64(2 * level + 1) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        """Distinct keys only; a level's keys that share a bit go to the next level."""
        levels = []
        while len(a):
            size = max(1, math.ceil(GAMMA * len(a)))
            at = cls.place(a, b, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            again = ~alone[at]
            a, b = a[again], b[again]
        return cls(levels)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of keys that aren't members, some slot or -1: the caller compares the digest there."""
        out = np.full(len(a), -1, dtype=np.int64)
        todo = np.arange(len(a))
        for k, bits in enumerate(self.levels):
            if not len(todo):
                break
            at = self.place(a[todo], b[todo], k, len(bits))
            hit = bits[at]
            out[todo[hit]] = self.before[k] + self.ranks[k][at[hit]]
            todo = todo[~hit]
        return out


def _matrix(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), dtype=np.uint8).reshape(-1, 32)


def _keys(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """digests: (n, 32) bytes."""
    halves = np.ascontiguousarray(digests).view(np.uint64)
    return halves[:, 0].copy(), halves[:, 1].copy()


def digests(docs: DataFrame) -> DataFrame:
    """row (a number that only this frame's copy gives a row), doc_id, digest (32 bytes), n: the code points of the original text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.unhex(F.sha2(F.regexp_replace(text, SPACES, "").cast("binary"), 256)).alias("digest"), F.length(text).cast("long").alias("n"))


def distinct(keyed: DataFrame) -> DataFrame:
    """digest, best, copies.  best orders rows: the least stays."""
    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    return keyed.groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("copies"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _index_schema(best: str) -> str:
    return f"shard int, shards int, sizes array<int>, bits binary, slots binary, bests array<{best}>, copies array<long>"


def build_index(groups: DataFrame) -> DataFrame:
    """One row a shard: the packed hash, and by slot the digests, bests and counts.  groups: rows as `digests` gives them, or durable groups of `distinct`."""
    if "best" not in groups.columns:
        groups = durable(distinct(groups))
    shards = max(1, math.ceil(groups.count() / SHARD_KEYS))

    def pack(table: pa.Table) -> pa.Table:
        m = _matrix(table["digest"])
        a, b = _keys(m)
        mph = PerfectHash.build(a, b)
        order = np.argsort(mph.slots(a, b))
        best, copies = table["best"].combine_chunks().take(pa.array(order)), table["copies"].combine_chunks().take(pa.array(order))
        return pa.table(
            {
                "shard": table["shard"].slice(0, 1), "shards": pa.array([shards], pa.int32()),
                "sizes": _listed(pa.array([len(x) for x in mph.levels], pa.int32())), "bits": pa.array([b"".join(np.packbits(x).tobytes() for x in mph.levels)], pa.binary()),
                "slots": pa.array([m[order].tobytes()], pa.binary()), "bests": _listed(best), "copies": _listed(copies),
            }
        )

    flat = groups.select(_shard(shards).alias("shard"), "digest", "best", "copies")
    return flat.groupBy("shard").applyInArrow(pack, _index_schema(groups.schema["best"].dataType.simpleString()))


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type as a schema string names it: all that a struct holds may be null."""
    return pa.struct([pa.field(f.name, f.type) for f in kind]) if pa.types.is_struct(kind) else kind


def _listed(values: pa.Array) -> pa.Array:
    """One row that holds all values."""
    values = values.cast(_nullable(values.type))
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values, type=pa.list_(pa.field("element", values.type)))


def _unpack(row: pa.Table) -> tuple[PerfectHash, np.ndarray]:
    levels, at = [], 0
    bits = row["bits"][0].as_py()
    for size in row["sizes"][0].as_py():
        n = (size + 7) // 8
        levels.append(np.unpackbits(np.frombuffer(bits, np.uint8, n, at))[:size].astype(bool))
        at += n
    return PerfectHash(levels), np.frombuffer(row["slots"][0].as_py(), np.uint8).reshape(-1, 32)


def _find(asked: pa.Table, index: pa.Table) -> np.ndarray:
    """The slot of each digest that the shard holds, byte by byte; -1 for the others."""
    if not len(asked) or not len(index):
        return np.full(len(asked), -1, np.int64)
    mph, slots = _unpack(index)
    m = _matrix(asked["digest"])
    at = mph.slots(*_keys(m))
    return np.where((at >= 0) & (slots[at] == m).all(axis=1), at, -1) if len(slots) else np.full(len(asked), -1, np.int64)


def _shards_of(index: DataFrame) -> int:
    first = index.select("shards").limit(1).collect()
    return first[0][0] if first else 1


def lookup(asked: DataFrame, index: DataFrame) -> DataFrame:
    """The rows asked (durable, with a digest and other columns of plain types) with `known`: best and copies, null for nonmembers."""
    shards = _shards_of(index)
    sizes = durable(asked.groupBy(_shard(shards).alias("shard")).agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("salts")))
    rows = join_small(asked.withColumn("shard", _shard(shards)), sizes, ["shard"], salt=F.xxhash64(*asked.columns))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*asked.columns), F.col("salts")).cast("int")).drop("salts")
    copies = index.join(sizes, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "shards")
    columns = asked.columns

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        at = _find(left, right)
        where = pa.array(np.where(at < 0, 0, at), mask=at < 0)
        out = left.select(columns)
        out = out.cast(pa.schema([(f.name, _nullable(f.type)) for f in out.schema]))
        if len(right):
            best, count = (right[c].combine_chunks().flatten().take(where) for c in ("bests", "copies"))
        else:
            best, count = (pa.nulls(len(left), right[c].type.value_type) for c in ("bests", "copies"))
        best = best.cast(_nullable(best.type))
        return out.append_column("best", best).append_column("copies", count)

    kind = index.schema["bests"].dataType.elementType.simpleString()
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
    return rows.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(probe, f"{own}, best {kind}, copies long")


def update(index: DataFrame, groups: DataFrame) -> DataFrame:
    """The index with the bests and counts of further rows of its members.  groups: digest, best, copies; nonmembers are passed over."""
    shards = _shards_of(index)
    columns = index.columns

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        at = _find(right, left)
        bests, copies = left["bests"].combine_chunks().flatten(), left["copies"].combine_chunks().flatten().to_numpy(zero_copy_only=False).copy()
        hit = np.flatnonzero(at >= 0)
        copies[at[hit]] += right["copies"].to_numpy()[hit]
        old, new = bests.take(pa.array(at[hit])).to_pylist(), right["best"].combine_chunks().take(pa.array(hit)).to_pylist()
        order = lambda b: (b["n"], b["none"], 0 if b["none"] else b["doc_id"], b["row"])
        better = {int(at[i]): len(bests) + k for k, (i, o, b) in enumerate(zip(hit, old, new, strict=True)) if order(b) < order(o)}
        both = pa.concat_arrays([bests, pa.array(new, bests.type)])
        bests = both.take(pa.array([better.get(k, k) for k in range(len(bests))], pa.int64()))
        out = {c: left[c] for c in columns} | {"bests": _listed(bests), "copies": _listed(pa.array(copies, pa.int64()))}
        return pa.table(out) if len(left) else pa.table({c: left[c].cast(pa.list_(pa.field("element", _nullable(left[c].type.value_type)))) if pa.types.is_list(left[c].type) else left[c] for c in columns})

    further = groups.select(_shard(shards).alias("shard"), "digest", "best", "copies")
    return index.groupBy("shard").cogroup(further.groupBy("shard")).applyInArrow(merge, _index_schema(index.schema["bests"].dataType.elementType.simpleString()))


def dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document.

    history: an index (durable) of texts seen before, whose winners stay and whose repeats go; without one, half
    of the table's own rows are the history of the others.
    """
    keyed = durable(digests(docs))
    own = history is None
    if own:
        even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
        history = durable(build_index(keyed.where(even)))
    asked = durable(lookup(durable(distinct(keyed.where(~even) if own else keyed).withColumnsRenamed({"best": "mine", "copies": "rows"})), history))
    named = {"mine": "best", "rows": "copies"}
    if own:
        history = durable(update(history, asked.where("best IS NOT NULL").select("digest", "mine", "rows").withColumnsRenamed(named)))
    others = durable(asked.where("best IS NULL").select("digest", "mine", "rows").withColumnsRenamed(named))
    found = lookup(keyed, history)
    if not others.isEmpty():
        found = durable(found)
        rest = lookup(found.where("best IS NULL").drop("best", "copies"), durable(build_index(others)))
        found = found.where("best IS NOT NULL").withColumn("old", F.lit(True)).unionByName(rest.withColumn("old", F.lit(False)))
    else:
        found = found.withColumn("old", F.lit(True))
    kept = F.col("best.row") == F.col("row")
    return found.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("copies").alias("group_size"), (kept if own else kept & ~F.col("old")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each digest, with all its columns.  Of repeated rows one stays; a null id is an id."""
    found = durable(dedup(docs))
    gone = durable(found.where("NOT kept").select("doc_id").distinct())
    alone = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1 OR doc_id IS NULL").isEmpty()
    if alone:
        return without(docs, gone)
    # rows that share an id are told apart by their text, at the price of a shuffle
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("_sha", F.sha2(F.regexp_replace(text, SPACES, "").cast("binary"), 256)).withColumn("_n", F.length(text).cast("long"))
    stay = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha2"), F.col("n").alias("_n2"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_sha2")) & (F.col("_n") == F.col("_n2"))
    return keyed.join(stay, on, "left_semi").dropDuplicates(["_sha"]).drop("_sha", "_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n")


SQL = r"""
WITH keyed AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM keyed)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM ranked
"""
