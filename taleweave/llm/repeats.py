"""Words that a document repeats from one with a smaller id, found by suffix automata over shards of the corpus.

The reference is the corpus itself, so it isn't broadcast whole to every document: that would be all documents by all
shards.  Passages are dealt to shards instead, so that a window of `WINDOW` words and all its copies meet in one shard:

1. Texts with the same words are one class; only the one with the smallest id is looked at.  The others repeat all
   their windows.
2. Each window has an anchor, the least hash among its `GRAM`-word sequences (the leftmost one).  Anchors that only one
   class has are dropped: a window with such an anchor stands in no other text.
3. The words of neighbouring windows with one anchor are a piece.  Equal pieces are counted together before they move.
   A piece goes to the shard of its anchor's hash; where an anchor stands in more than `CROWD` places, its windows
   go to shards one by one by the hash of their own words.
4. A shard's task builds the suffix automaton of its distinct pieces, each state with the smallest id that its words
   occur in, and streams the pieces through it: at each word, the matching statistic (up to `WINDOW`, the length
   threshold) leads to the state of the last `WINDOW` words, and so to the first document that has them.
5. Windows whose first document is smaller than their own are removed, overlapping ones as one maximal span.

Hashes only decide what meets where; equal windows always meet, and the automaton compares words.

Defined results: null counts as no words; fewer words than `WINDOW` stay; null ids are larger than all others; of rows
with one id and one text none is smaller than the other; a window that one document repeats within itself stays; ids
keep their type, and order as Spark orders them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import compact, durable, frugal, join_small, shuffles_dropped, small, stored, table

WINDOW, GRAM = 13, 5
#: Places of an anchor beyond which its windows are dealt one by one, and places that a shard has about.
CROWD, SHARD = 2_000, 4_000
#: Characters that a task looks at together: its arrays take about fifty times as many bytes.
SLICE = 300_000
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_NONE = hashlib.sha256(b"").digest()


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << n.bit_length()
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up[:n], cls.down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


def word_hashes(joined: bytes) -> np.ndarray:
    """A hash of each word of words joined by single spaces: the same wherever the word stands."""
    buf = np.frombuffer(joined, np.uint8)
    up, down = _Powers.upto(len(buf) + 1)
    ends = np.append(np.flatnonzero(buf == 32), len(buf))
    starts = np.append(0, ends[:-1] + 1)
    sums = np.append(np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1]))
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each sequence of n words."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + h[j : j + len(out)]
    return _mixed(out)


def anchors(words: list[list[bytes]], window: int = WINDOW, gram: int = GRAM):
    """For lists of words: (list, hash, first window, windows) of each anchor, as arrays; positions are in the list."""
    sizes = np.array([len(w) for w in words], np.int64)
    none = np.zeros(0, np.int64)
    if not (sizes >= window).any():
        return none, none, none, none
    starts = np.append(0, np.cumsum(sizes)[:-1])
    g = _grams(word_hashes(b" ".join([b" ".join(w) for w in words if w])), gram)
    own = np.repeat(np.arange(len(words)), np.maximum(sizes - window + 1, 0))
    at = np.arange(len(own)) - np.repeat(np.append(0, np.cumsum(np.maximum(sizes - window + 1, 0))[:-1]), np.maximum(sizes - window + 1, 0)) + starts[own]
    least = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1)[at].argmin(1) + at
    first = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (own[1:] != own[:-1])))
    windows = np.diff(np.append(first, len(own)))
    return own[first], g[least[first]].view(np.int64), at[first] - starts[own[first]], windows


def _scan(batches):
    """(batch, words of each text, key of each text) in slices: the key is the digest of the words joined by spaces."""
    for batch in small(batches, "text", SLICE):
        words = [(t or "").encode().split() for t in batch.column("text").cast(pa.string()).to_pylist()]
        yield batch, words, [hashlib.sha256(b" ".join(w)).digest() for w in words]


def _short(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), np.int64)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, key, short of each row."""
    schema = StructType([docs.schema["doc_id"], StructField("n_words", LongType()), StructField("key", BinaryType()), StructField("short", LongType())])

    def run(batches):
        for batch, words, keys in _scan(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(keys, pa.binary()), pa.array(_short(keys))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _anchored(docs: DataFrame, places: bool, window: int, gram: int) -> DataFrame:
    """hash and short of each anchor, and with places `at`: 16 times its first window, and how many windows it has."""
    if window - gram >= 15:
        raise ValueError("an anchor has fewer than 16 windows")

    def run(batches):
        for _, words, keys in _scan(batches):
            own, h, at, n = anchors(words, window, gram)
            columns = [pa.array(h), pa.array(_short(keys)[own]), *([pa.array(16 * at + n)] if places else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "short", "at"][: len(columns)])

    return docs.select("text").mapInArrow(run, "hash long, short long" + ", at long" * places)


def shared_anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """hash and n of anchors that more than one class has; n counts places."""
    found = _anchored(docs, False, window, gram).groupBy("hash").agg(F.min("short").alias("lo"), F.max("short").alias("hi"), F.count(F.lit(1)).alias("n"))
    return compact(found.where("lo < hi").select("hash", "n"))


def _with_places(docs: DataFrame, rows: DataFrame, window: int, gram: int, crowd: int) -> tuple[DataFrame, int]:
    """_row, key, first, text and places of the smallest document of each class with shared anchors; and the number of shards."""
    shared = shared_anchors(docs, window, gram)
    shards = max(1, -(-int(shared.agg(F.sum(F.least("n", F.lit(crowd)))).first()[0] or 0) // SHARD))
    shard = F.when(F.col("n") > crowd, -1).otherwise(F.pmod("hash", F.lit(shards))).cast("long")  # -1: window by window
    places = join_small(_anchored(docs, True, window, gram), shared.select("hash", shard.alias("shard")), ["hash"], "inner")
    places = places.groupBy("short").agg(F.collect_set(F.struct("at", "shard")).alias("places"))
    firsts = rows.groupBy("key", "short").agg(F.min("doc_id").alias("first"))
    chosen = firsts.join(places, "short").select("key", "first", "places")
    schema = StructType([docs.schema["doc_id"], StructField("text", StringType()), StructField("key", BinaryType())])

    def keyed(batches):
        for batch, _, keys in _scan(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text").cast(pa.string()), pa.array(keys, pa.binary())], names=schema.names)

    texts = docs.mapInArrow(keyed, schema)
    both = texts.join(chosen, (texts["key"] == chosen["key"]) & texts["doc_id"].eqNullSafe(chosen["first"])).select(chosen["key"], "first", "text", "places")
    return stored(both.withColumn("_row", F.monotonically_increasing_id()), "places", "zstd"), shards


def _pieces(found: DataFrame, shards: int, text: bool, window: int) -> DataFrame:
    """_row, first, at, p, q of each piece (p and q are its digest), or first, piece, shard."""
    first = found.schema["first"]
    own = [first, StructField("piece", BinaryType()), StructField("shard", IntegerType())] if text else [StructField("_row", LongType()), first, StructField("at", IntegerType()), StructField("p", LongType()), StructField("q", LongType())]

    def run(batches):
        for batch in small(batches, "text", SLICE):
            there, starts, cuts, dealt = [], [], [], []
            lists = batch.column("places")
            at, shard = (lists.flatten().field(k).to_pylist() for k in (0, 1))
            ends = np.cumsum(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)).tolist()
            k = 0
            for d, (t, end) in enumerate(zip(batch.column("text").to_pylist(), ends, strict=True)):
                words = (t or "").encode().split()
                for k in range(k, end):  # noqa: B020, PLW2901
                    i, n = divmod(at[k], 16)
                    for j, size in ((i, n + window - 1),) if shard[k] >= 0 else ((j, window) for j in range(i, i + n)):
                        there.append(d)
                        starts.append(j)
                        cuts.append(b" ".join(words[j : j + size]))
                        dealt.append(shard[k])
                k = end
            rows = pa.array(there, pa.int64())
            if text:
                dealt = [x if x >= 0 else int.from_bytes(hashlib.md5(c).digest()[:6]) % shards for x, c in zip(dealt, cuts, strict=True)]
                columns = [batch.column("first").take(rows), pa.array(cuts, pa.binary()), pa.array(dealt, pa.int32())]
            else:
                digests = np.frombuffer(b"".join(hashlib.md5(c).digest() for c in cuts), np.int64).reshape(-1, 2)
                columns = [batch.column("_row").take(rows), batch.column("first").take(rows), pa.array(starts, pa.int32()), pa.array(digests[:, 0]), pa.array(digests[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in own])

    return found.select("_row", "first", "text", "places").mapInArrow(run, StructType(own))


class Automaton:
    """Suffix automaton of several sequences; each state knows the smallest rank among the sequences that its words occur in."""

    def __init__(self, sequences: list[list], ranks: list[int]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 62]
        for words, rank in zip(sequences, ranks, strict=True):
            last = 0
            for w in words:
                last = self._extend(last, w)
                if rank < self.least[last]:
                    self.least[last] = rank
        link, least = self.link, self.least
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if least[v] < least[link[v]]:
                least[link[v]] = least[v]

    def _extend(self, last: int, w) -> int:
        nexts, link, length = self.next, self.link, self.length
        q = nexts[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.least.append(1 << 62)
        p = last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w, q: int) -> int:
        nexts, link = self.next, self.link
        made = len(nexts)
        nexts.append(dict(nexts[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.least.append(1 << 62)
        link[q] = made
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = made
            p = link[p]
        return made

    def statistics(self, words: list, window: int) -> list[int]:
        """For each window of words, the smallest rank among the sequences that have it (2^62: none).

        The match is the longest suffix of what was read that occurs, up to `window` words.
        """
        nexts, link, length, least = self.next, self.link, self.length, self.least
        v = size = 0
        out = []
        for i, w in enumerate(words):
            while v and w not in nexts[v]:
                v = link[v]
                size = length[v]
            if w in nexts[v]:
                v = nexts[v][w]
                size += 1
            if size >= window:
                while length[link[v]] >= window:
                    v = link[v]
                size = window
            if i >= window - 1:
                out.append(least[v] if size >= window else 1 << 62)
        return out


def first_documents(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """p, q and least: for each window of a distinct piece, the smallest document that has it; pieces that none of their documents repeats are left out."""
    kind = pieces.schema["first"].dataType
    distinct = pieces.groupBy("piece", "shard").agg(F.min("first").alias("lo"), F.max("first").alias("hi"), F.max(F.col("first").isNull()).alias("unknown"))
    schema = StructType([StructField("p", LongType()), StructField("q", LongType()), StructField("least", ArrayType(kind))])

    def run(group: pa.Table) -> pa.Table:
        texts = [p.split() for p in group.column("piece").to_pylist()]
        lo, hi, unknown = (group.column(n).to_pylist() for n in ("lo", "hi", "unknown"))
        known = sorted({x for x in lo if x is not None})
        ranks = {x: i for i, x in enumerate(known)} | {None: len(known)}
        numbers: dict[bytes, int] = {}
        sequences = [[numbers.setdefault(w, len(numbers)) for w in t] for t in texts]
        shard = Automaton(sequences, [ranks[x] for x in lo])
        pids, least = [], []
        for piece, words, largest, odd in zip(group.column("piece").to_pylist(), sequences, hi, unknown, strict=True):
            found = [known[r] if r < len(known) else None for r in shard.statistics(words, window)]
            if any(x is not None and (odd or x < largest) for x in found):
                pids.append(hashlib.md5(piece).digest())
                least.append(found)
        digests = np.frombuffer(b"".join(pids), np.int64).reshape(-1, 2)
        return pa.table([pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(least, pa.list_(group.schema.field("lo").type))], names=["p", "q", "least"])

    return distinct.groupBy("shard").applyInArrow(run, schema)


def _smaller(x: Column, y: Column) -> Column:
    return x.isNotNull() & (y.isNull() | (x < y))


def repeated_windows(docs: DataFrame, rows: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """key, text and gone (first words of the windows to remove) of each class whose smallest document repeats some."""
    found, shards = _with_places(docs, rows, window, gram, crowd)
    answers = first_documents(_pieces(found, shards, True, window), window)
    each = _pieces(found, shards, False, window).join(answers, ["p", "q"])
    own = F.filter(F.transform("least", lambda x, i: F.when(_smaller(x, F.col("first")), F.col("at") + i)), lambda i: i.isNotNull())
    gone = each.select("_row", own.alias("gone")).where(F.size("gone") > 0).groupBy("_row").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    return found.select("_row", "key", "text").join(gone, "_row").drop("_row")


def spans(starts: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal spans (from, to) that windows cover."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], s + window
        else:
            out.append((s, s + window))
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    docs = frugal(docs.select("doc_id", "text"))
    with shuffles_dropped(docs.sparkSession):
        rows = durable(classes(docs))
        windows = repeated_windows(docs, rows, window, gram, crowd)
    schema = StructType([StructField("key", BinaryType()), StructField("n", LongType()), StructField("kept", BinaryType())])

    def cut(batches):
        for batch in small(batches, "text"):
            n, kept = [], []
            for t, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                words, left, at = t.encode().split(), [], 0
                for a, b in spans(gone, window):
                    left += words[at:a]
                    at = b
                left += words[at:]
                n.append(len(words) - len(left))
                kept.append(hashlib.sha256(b" ".join(left)).digest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(kept, pa.binary())], names=schema.names)

    found = windows.mapInArrow(cut, schema)
    found = found.groupBy("key").agg(F.first("n").alias("n"), F.first("kept").alias("kept"))  # rows with one id and one text
    about = rows.groupBy("key").agg(F.min("doc_id").alias("first")).join(found, "key", "left")
    first, long = F.col("doc_id").eqNullSafe(F.col("first")), F.col("n_words") >= window
    removed = F.when(first, F.coalesce("n", F.lit(0))).when(long, F.col("n_words")).otherwise(0).cast("long")
    kept = F.when(first, F.coalesce("kept", "key")).when(long, F.lit(bytearray(_NONE))).otherwise(F.col("key"))
    return rows.join(about, "key").select("doc_id", "n_words", removed.alias("n_removed"), F.lower(F.hex(kept)).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT r, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s),
gone AS (SELECT DISTINCT r, i + j AS p FROM g JOIN f USING (s) CROSS JOIN range(0, {WINDOW}) t(j) WHERE m < doc_id),
each AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
