"""Two tokenizers' tokens of the same text, aligned by bytes, and how often their ids are linked in a corpus.

Arrow tasks only tokenise: each text becomes the ids of A and of B and, for each token, the byte where it ends.
The tokenising task also says which token each byte belongs to (a tokenizer's offset mapping), so that the token at
any byte is one look-up.  All else is Spark's higher-order functions over these arrays, linear in a text's length: the
common ends (`array_intersect`) cut the tokens into groups.  The union of ends cuts the text into intervals, and every
interval is one link: the A token and the B token there overlap, and two tokens share no second interval.

Neither tokenizer joins what stands before a space to what follows it, so a text is cut before each space that
follows no white space; a worker remembers the ids of `REMEMBERED` chunks, and the unknown chunks of a shelf are
encoded together.  `merged_alike` and `spaces_lead` check that the vocabularies allow it.  No group and no link
crosses a cut, so the documents of a shelf (`SHELF` characters) share the alignment of their distinct chunks, and all
shelves that of the heads: up to `HEADS` chunks that are frequent in a sample, which are aligned once, by the same
functions, and broadcast.  The sample decides on nothing else: every other chunk is aligned in its shelf.

Links are counted over the corpus by id pair: tasks sum those of their shelves, Spark the sums.  Pairs with counts from
a threshold on, so many as fit in `BROADCAST_PAIRS`, are broadcast to the links, which are summed by document where
they lie; links of rarer pairs are joined by a shuffle.

Defined results: null and empty texts, and texts whose tokens don't give back space and text byte by byte (invalid
for either vocabulary), have no tokens, and their group text is empty; strings of special tokens are plain text;
repeated rows, with one id or not, are rows of their own and all of them count; null ids stay null; ids keep their
type; texts of any length are aligned whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import durable, frugal, small, stored, table
from .sentencepieces import BYTE, MARK, NORMAL, USER, parse_model

#: Where the public vocabulary files are.  Parameters of every function here.
A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Chunks whose ids a worker remembers, and id pairs that are broadcast at most (24 bytes each).
REMEMBERED, BROADCAST_PAIRS = 120_000, 1_000_000
#: Frequent chunks that are aligned once for all documents, at most, and the share of the texts that they are looked for in.
HEADS, SAMPLE = 330_000, 16
#: Characters of the documents whose distinct chunks are aligned together.
SHELF = 1_000_000
#: Shelves of a file in between: a reader holds them together.
FILE_SHELVES = 2
#: What the byte-level tokenizer's pre-tokenizer cuts a text by (fixed value, public).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT, _RUN = re.compile(r"(?<=\S) "), re.compile(r"\s ")
_LISTS = ("a_ids", "a_ends", "a_of", "b_ids", "b_ends", "b_of")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def merged_alike(spec: dict, found: dict[str, int]) -> bool:
    """Whether the file's merges are in the order of the ids that they make: the lowest id is then the first merge."""
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    ids = [found[x + y] for x, y in merges]
    return ids == sorted(ids) and spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True)


def spaces_lead(pieces: list) -> bool:
    """Whether no piece has the mark of a space after another character: no merge crosses a space's left side."""
    return not any(MARK in p.lstrip(MARK) for p, *_ in pieces)


def cut(text: str | None) -> list[str]:
    """A text's chunks: it is cut at each space that follows no white space."""
    if not text:
        return []
    return _CUT.split(text) if text[0] == " " or _RUN.search(text) else text.split(" ")


class _Places(dict):
    """The place of each distinct chunk, in the order that they are met in."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


def _owners(sizes: np.ndarray) -> np.ndarray:
    """For each byte, the position of what it belongs to."""
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


class Pair:
    """Both tokenizers of a worker, with the bytes of their tokens and the chunks that it remembers."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken

        spec, alphabet = json.loads(a_file), byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        found = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        model = parse_model(b_file)
        if not merged_alike(spec, found) or not spaces_lead(model["pieces"]) or model["squeeze"] or model["charsmap"] or not model["prefix"] or any(k == USER for *_, k in model["pieces"]):
            raise ValueError("these tokenizers can't be cut at spaces")
        a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in found.items()}
        self.a = tiktoken.Encoding("A", pat_str=PATTERN, mergeable_ranks={b: i for i, b in a_bytes.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k == NORMAL else b"" for p, _, k in model["pieces"]]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int32) for t in (self.a_bytes, self.b_bytes))
        self.alone = self.b.piece_to_id(MARK)
        self.known: dict[str, tuple | None] = {}

    def _learn(self, chunks: list[str]) -> None:
        """Remember new chunks, encoded as one text; its ids are cut where chunks end.  Chunks that end in white space come alone.  None: bytes differ."""
        joined = " ".join(chunks)
        a = np.array(self.a.encode_ordinary(" " + joined), np.int32)
        b = np.array([*self.b.encode(joined, num_threads=1), *([self.alone] if not chunks[-1] else [])], np.int32)
        ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
        same = [b"".join(map(t.__getitem__, ids.tolist())) == (" " + joined).encode() for t, ids in ((self.a_bytes, a), (self.b_bytes, b))]
        if not all(same):
            if len(chunks) == 1:
                self.known[chunks[0]] = None
            else:
                half = len(chunks) // 2
                self._learn(chunks[:half])
                self._learn(chunks[half:])
            return
        a_at, b_at = (np.searchsorted(np.cumsum(sizes[ids]), ends, "right") for ids, sizes in ((a, self.a_sizes), (b, self.b_sizes)))
        i = j = 0
        for c, p, q in zip(chunks, a_at.tolist(), b_at.tolist(), strict=True):
            self.known[c] = a[i:p].tobytes(), b[j:q].tobytes()
            i, j = p, q

    def forget(self) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()

    def learn(self, chunks) -> None:
        """Encode those chunks that aren't known."""
        new = [c for c in chunks if c not in self.known]
        apart = [c for c in new if not c or c[-1].isspace()]
        together = [c for c in new if c and not c[-1].isspace()]
        for own in [*([c] for c in apart), *(together[k : k + 2000] for k in range(0, len(together), 2000))]:
            self._learn(own)

    def tokens(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """ids, ends and the token of each byte, of A and of B, for known chunks end to end; none if one has no tokens."""
        if not chunks or any(self.known[c] is None for c in chunks):
            return (np.zeros(0, np.int32),) * 6
        out = []
        for parts, sizes in zip(zip(*map(self.known.__getitem__, chunks), strict=True), (self.a_sizes, self.b_sizes), strict=True):
            ids = np.frombuffer(b"".join(parts), np.int32)
            out += [ids, np.cumsum(sizes[ids], dtype=np.int32), _owners(sizes[ids])]
        return tuple(out)


@lru_cache(1)
def _pair(a_file: bytes, b_file: bytes) -> Pair:
    return Pair(a_file, b_file)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


_INTS = ArrayType(IntegerType(), False)


def _lists(own: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, own)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own).astype(np.int32) if own else np.zeros(0, np.int32)), type=pa.list_(pa.field("element", pa.int32(), False)))


def _files(*paths: str) -> tuple[bytes, ...]:
    """The driver reads both vocabulary files (3 MB)."""
    return tuple(open(path, "rb").read() for path in paths)


def tokens(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """doc_id, a_ids, a_ends, a_of, b_ids, b_ends, b_of: ids, the bytes of space and text where each token ends, and the token of each byte."""
    files, docs = _files(a_file, b_file), docs.select("doc_id", "text")

    def run(batches):
        pair = _pair(*files)
        for batch in small(batches, "text"):
            found = []
            for own in map(cut, batch.column("text").cast(pa.string()).to_pylist()):
                pair.learn(set(own))
                found.append(pair.tokens(own))
                pair.forget()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[_lists([x[k] for x in found]) for k in range(6)]], names=["doc_id", *_LISTS])

    return frugal(docs).mapInArrow(run, StructType([docs.schema["doc_id"], *[StructField(n, _INTS, False) for n in _LISTS]]))


def _renumbered(own: list[np.ndarray], at: dict[str, int], bad: set[int]) -> tuple[list[np.ndarray], dict[str, int]]:
    """Positions without the bad chunks, which no list has."""
    left = [(c, i) for c, i in at.items() if i not in bad]
    new = {i: k for k, (_, i) in enumerate(left)}
    return [np.array([new[i] for i in x.tolist()], np.int32) for x in own], {c: k for k, (c, _) in enumerate(left)}


class Heads(NamedTuple):
    """Frequent chunks, aligned once: what workers know of them."""

    chunks: list[str]
    sizes: np.ndarray  # (3, chunks): n_a, n_b, n_groups
    texts: pa.Array
    links: np.ndarray  # of all, end to end


def frequent_chunks(docs: DataFrame) -> DataFrame:
    """chunk, count of chunks that a `SAMPLE`th of the texts has more than once.  The choice only decides on what is aligned once."""
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)

    def run(batches):
        for batch in small(batches, "text", 8_000_000):
            found = Counter(c for t in batch.column("text").cast(pa.string()).to_pylist() for c in cut(t))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["chunk", "count"])

    counted = frugal(some).mapInArrow(run, "chunk string, count long").where("chunk <> ''")
    return durable(counted.groupBy("chunk").agg(F.sum("count").alias("count")).where("count > 1"))


def heads_of(docs: DataFrame, a_file: str, b_file: str) -> Heads:
    """The most frequent chunks (at most `HEADS`), aligned: they are all that comes to the driver."""
    counts = frequent_chunks(docs)
    chosen = counts.where(F.col("count") >= frequent(counts, HEADS)).select(F.col("chunk").alias("doc_id"), F.col("chunk").alias("text"))
    rows = aligned(tokens(chosen, a_file, b_file)).where(_there("a_ids"))
    found = rows.select("doc_id", F.size("a_ids").alias("n_a"), F.size("b_ids").alias("n_b"), F.size("groups").alias("n_groups"), F.array_join("groups", ";").alias("text"), at_links(("link", link))["link"].alias("links")).toArrow().combine_chunks()
    flat = {n: found.column(n).combine_chunks() for n in found.schema.names}
    flat = {n: c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for n, c in flat.items()}
    sizes = np.stack([flat[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("n_a", "n_b", "n_groups")])
    return Heads(flat["doc_id"].to_pylist(), sizes, flat["text"].cast(pa.string()), flat["links"].flatten().to_numpy(zero_copy_only=False))


def shelves(docs: DataFrame, heads: Broadcast, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """A row for some documents (about `SHELF` characters, or one longer text), with each distinct chunk of theirs once.

    docs: doc_id, chunks (positions among the distinct chunks, the heads first), n_a, n_b of each; heads, head_times,
    head_texts: the distinct chunks that are heads, how often the documents have them, their groups; times, sizes
    (n_a + n_b) of each other chunk; chunk_of: the chunk of each byte; the columns of `tokens`: of the others, end to end.
    """
    files, docs = _files(a_file, b_file), docs.select("doc_id", "text")
    one = StructType([docs.schema["doc_id"], StructField("chunks", _INTS, False), StructField("n_a", IntegerType(), False), StructField("n_b", IntegerType(), False)])
    ints = ("heads", "head_times", "times", "sizes", "chunk_of", *_LISTS)
    schema = StructType([StructField("docs", ArrayType(one, False), False), StructField("head_texts", ArrayType(StringType(), False), False), *[StructField(n, _INTS, False) for n in ints]])

    fields = [pa.field("chunks", pa.list_(pa.field("element", pa.int32(), False)), False), pa.field("n_a", pa.int32(), False), pa.field("n_b", pa.int32(), False)]

    def shelf(pair: Pair, known: Heads, head_at: dict[str, int], ids: pa.Array, own: list, at: dict[str, int]) -> pa.RecordBatch:
        pair.learn([c for c in at if c not in head_at])
        if bad := {i for c, i in at.items() if c not in head_at and pair.known[c] is None}:
            own, at = _renumbered([x[:0] if bad.intersection(x.tolist()) else x for x in own], at, bad)
        head = np.array([head_at.get(c, -1) for c in at], np.int32)
        order = np.argsort(head < 0, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        used = head[head >= 0]
        rest = [c for c, h in zip(at, head.tolist(), strict=True) if h < 0]
        n = [np.concatenate([known.sizes[k][used], [len(pair.known[c][k]) // 4 for c in rest]]).astype(np.int64) for k in (0, 1)]
        own = [place[x] for x in own]
        sums = [pa.array([int(x[i].sum()) for i in own], pa.int32()) for x in n]
        listed = pa.StructArray.from_arrays([ids, _lists(own), *sums], fields=[pa.field("doc_id", ids.type), *fields])
        times = np.bincount(np.concatenate(own), minlength=len(at)) if at else np.zeros(0, np.int32)
        h = len(used)
        lists = (used, times[:h], times[h:], (n[0] + n[1])[h:], _owners(np.array([len(c.encode()) + 1 for c in rest], np.int64)), *pair.tokens(rest))
        texts = pa.ListArray.from_arrays(pa.array([0, h], pa.int32()), known.texts.take(pa.array(used)), type=pa.list_(pa.field("element", pa.string(), False)))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), listed), texts, *[_lists([x]) for x in lists]], names=schema.names)

    def run(batches):
        pair, known = _pair(*files), heads.value
        head_at = {c: i for i, c in enumerate(known.chunks)}
        ids, own, at, size = [], [], _Places(), 0
        for batch in small(batches, "text"):
            for t in batch.column("text").cast(pa.string()).to_pylist():
                chunks = cut(t)
                own.append(np.fromiter(map(at.__getitem__, chunks), np.int32, len(chunks)))
                size += len(t or "")
            ids.append(batch.column("doc_id"))
            if size >= SHELF:
                yield shelf(pair, known, head_at, pa.concat_arrays(ids), own, at)
                ids, own, at, size = [], [], _Places(), 0
                pair.forget()
        if own:
            yield shelf(pair, known, head_at, pa.concat_arrays(ids), own, at)

    return frugal(docs).mapInArrow(run, schema)


def _there(*columns: str) -> Column:
    """That none is empty.  Sets are long to make: what a project reads twice, the optimizer doesn't put into a lambda, to be made for each element."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.size(c) > 0)
    return out


def aligned(found: DataFrame) -> DataFrame:
    """Adds group_ends and link_ends, bytes in text order, and groups (`a1,a2|b1` for each).  `found` has the columns of `tokens`."""
    made = {"group_ends": F.array_intersect("a_ends", "b_ends"), "link_ends": F.sort_array(F.array_union("a_ends", "b_ends")), "_sa": F.col("a_ids").cast("array<string>"), "_sb": F.col("b_ids").cast("array<string>")}

    def part(ids: str, of: str, before: Column, end: Column) -> Column:
        first, last = F.get(of, before), F.get(of, end - 1)
        more = F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(ids, i)), ",")
        return F.when(first == last, F.get(ids, first)).otherwise(more)

    def group(end: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get("group_ends", k - 1)).otherwise(0)
        return F.concat(part("_sa", "a_of", before, end), F.lit("|"), part("_sb", "b_of", before, end))

    groups = F.when(_there("group_ends", "_sa", "_sb"), F.transform("group_ends", group)).otherwise(_empty("string"))
    return found.withColumns(made).withColumn("groups", groups).drop("_sa", "_sb")


def at_links(*values) -> Column:
    """A struct of some values for each link: each value is a function of the byte that the link ends with."""
    return F.transform("link_ends", lambda end: F.struct(*[value(end - 1).alias(name) for name, value in values]))


def link(byte: Column) -> Column:
    """A id * 2^32 + B id of the tokens there."""
    return F.shiftleft(F.get("a_ids", F.get("a_of", byte)).cast("long"), 32) + F.get("b_ids", F.get("b_of", byte))


def summary(docs: DataFrame, heads: Broadcast, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """By shelf: docs (doc_id, chunks, n_a, n_b, groups_sha256), heads, head_times, and of the other distinct chunks times, n_links and, end to end, links."""
    rows = aligned(shelves(docs, heads, a_file, b_file))
    chunk = lambda byte: F.get("chunk_of", byte)

    def closed(text: Column, k: Column) -> Column:
        """A group's text with what parts it from the next: a line end between chunks."""
        end = F.get("group_ends", k)
        return F.concat(text, F.when(chunk(end - 1) < F.coalesce(chunk(end), F.lit(-1)), "\n").otherwise(";"))

    joined = F.array_join(F.transform("groups", closed), "")
    texts = F.when(_there("groups", "group_ends"), F.split(F.substr(joined, F.lit(1), F.length(joined) - 1), "\n")).otherwise(_empty("string"))
    links = F.when(_there("link_ends"), F.transform("link_ends", lambda end: link(end - 1))).otherwise(_empty("long"))
    rows = rows.select("docs", "heads", "head_times", "head_texts", "times", "sizes", links.alias("links"), texts.alias("_tail_texts"))
    n_groups = F.transform("_tail_texts", lambda t: F.length(t) - F.length(F.replace(t, F.lit(";"), F.lit(""))) + 1)
    n_links = F.zip_with("sizes", n_groups, lambda n, g: n - g)
    rows = rows.select("docs", "heads", "head_times", "times", F.when(_there("_tail_texts"), n_links).otherwise(_empty("int")).alias("n_links"), "links", F.concat("head_texts", "_tail_texts").alias("_texts"))

    def digest(d: Column) -> Column:
        text = F.array_join(F.transform(d["chunks"], lambda k: F.get("_texts", k)), ";")
        return d.withField("groups_sha256", F.when((F.size(d["chunks"]) > 0) & (F.size("_texts") > 0), F.sha2(text, 256)).otherwise(""))

    return rows.select(F.transform("docs", digest).alias("docs"), "heads", "head_times", "times", "n_links", "links")


def _column(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)


def _summed(links: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(links, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, where, counts)
    return found, sums


def pair_counts(rows: DataFrame, heads: Broadcast) -> DataFrame:
    """link, count, best (whether no link of its B id has a higher count) over all shelves: tasks sum their rows' links, Spark the tasks' sums."""

    def run(batches):
        known = heads.value
        total, found = np.zeros(len(known.chunks), np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            for i in range(batch.num_rows):
                total[_column(batch, "heads", i)] += _column(batch, "head_times", i)
                own = _column(batch, "links", i), np.repeat(_column(batch, "times", i), _column(batch, "n_links", i))
                found = _summed(*(np.concatenate(x) for x in zip(found, own, strict=True)))
                if len(found[0]) > BROADCAST_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["link", "count"])
                    found = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        n_a, n_b, n_groups = known.sizes
        own = known.links, np.repeat(total, n_a + n_b - n_groups)
        link, count = _summed(*(np.concatenate(x) for x in zip(found, own, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x[count > 0]) for x in (link, count)], names=["link", "count"])

    each = rows.select("heads", "head_times", "times", "n_links", "links").mapInArrow(run, "link long, count long")
    counts = durable(each.groupBy("link").agg(F.sum("count").alias("count")))
    own = F.col("link").bitwiseAND(F.lit(2**32 - 1))
    highest = counts.groupBy(own.alias("_b")).agg(F.max("count").alias("_highest"))
    return durable(counts.withColumn("_b", own).join(highest, "_b").select("link", "count", (F.col("count") == F.col("_highest")).alias("best")))


def frequent(counts: DataFrame, most: int = BROADCAST_PAIRS) -> int:
    """The least count from which on no more than `most` pairs are: a power of two, from at most 64 sums."""
    by_size = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = 62, 0
    for size, n in sorted(((r["size"], r["n"]) for r in by_size), reverse=True):
        total += n
        if total > most:
            break
        least = size
    return 2**least


def weights(rows: DataFrame, counts: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """_row, sums: (chunk, n_best, count_sum) of each distinct chunk of a shelf, in order."""
    least = frequent(counts, most)
    head, tail = counts.where(F.col("count") >= least), counts.where(F.col("count") < least)
    each = rows.select("_row", F.inline("links")).select("_row", "chunk", "link")  # as rows lie: only sums are shuffled

    def summed(links: DataFrame) -> DataFrame:
        return links.groupBy("_row", "chunk").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))

    out = summed(each.join(F.broadcast(head), "link"))
    if not tail.isEmpty():
        rare = summed(each.join(F.broadcast(head), "link", "left_anti").join(tail, "link"))
        out = out.unionByName(rare).groupBy("_row", "chunk").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("chunk", "n_best", "count_sum"))).alias("sums"))


class Sums:
    """What a shelf's chunks come to, by the pairs that are broadcast: link (sorted), count, best."""

    def __init__(self, known: Heads, pairs: tuple[np.ndarray, ...]):
        self.pairs, (n_a, n_b, n_groups) = pairs, known.sizes
        self.head_links, self.head_n = known.links, n_a + n_b - n_groups
        self.heads = self.of(known.links, self.head_n)
        self.head_at = np.cumsum(self.head_n) - self.head_n

    def of(self, links: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(3, chunks): links, best ones, the sum of counts; a link that isn't among the pairs counts 0.  links: of chunks with n each."""
        link, count, best = self.pairs
        at = np.minimum(np.searchsorted(link, links), max(0, len(link) - 1))
        there = link[at] == links if len(link) else np.zeros(len(links), bool)
        ends = np.cumsum(n)
        sums = [np.concatenate([[0], np.cumsum(np.where(there, x[at], 0) if len(link) else there)]) for x in (best.astype(np.int64), count)]
        return np.stack([n, *[x[ends] - x[ends - n] for x in sums]]).astype(np.int64)

    def rare(self, links: np.ndarray) -> np.ndarray:
        link = self.pairs[0]
        return link[np.minimum(np.searchsorted(link, links), len(link) - 1)] != links if len(link) else np.ones(len(links), bool)

    def chunks(self, batch: pa.RecordBatch, i: int) -> np.ndarray:
        """`of` a row's distinct chunks."""
        return np.concatenate([self.heads[:, _column(batch, "heads", i)], self.of(_column(batch, "links", i), _column(batch, "n_links", i))], axis=1)

    def rare_links(self, batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
        """The links of each distinct chunk of a row that aren't among the pairs."""
        own = [self.head_links[self.head_at[h] : self.head_at[h] + self.head_n[h]] for h in _column(batch, "heads", i)]
        n = _column(batch, "n_links", i)
        own += np.split(_column(batch, "links", i), np.cumsum(n)[:-1]) if len(n) else []
        return [x[self.rare(x)] for x in own]


def linked(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, most: int = BROADCAST_PAIRS) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    share = docs.sparkSession.sparkContext.broadcast
    heads = share(heads_of(docs, a_file, b_file))
    rows = stored(summary(docs, heads, a_file, b_file).withColumn("_row", F.monotonically_increasing_id()), "links", "zstd", FILE_SHELVES)
    counts = pair_counts(rows, heads)
    least = frequent(counts, most)
    found = counts.where(F.col("count") >= least).toArrow()
    by_link = np.argsort(found["link"].to_numpy())
    pairs = share(tuple(found[c].to_numpy()[by_link] for c in ("link", "count", "best")))
    names = ["_row", "_place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches):
        sums = Sums(heads.value, pairs.value)
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("docs")[i].values
                of = own.field("chunks")
                ends = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(sums.chunks(batch, i)[:, of.flatten().to_numpy()], axis=1)], axis=1)
                cuts = np.concatenate([[0], np.cumsum(of.value_lengths().to_numpy())]).astype(np.int64)
                n_links, n_best, count_sum = ends[:, cuts[1:]] - ends[:, cuts[:-1]]
                n_a, n_b = (own.field(n).to_numpy().astype(np.int64) for n in ("n_a", "n_b"))
                places = [np.full(len(own), batch.column("_row")[i].as_py()), np.arange(len(own))]
                made = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_a + n_b - n_links, n_links, n_best, count_sum)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in places], own.field("doc_id"), *made, own.field("groups_sha256")], names=names)

    def rare(batches):
        sums = Sums(heads.value, pairs.value)
        for batch in batches:
            for i in range(batch.num_rows):
                links = sums.rare_links(batch, i)
                own = [np.concatenate([links[k] for k in x]) if len(x) else np.zeros(0, np.int64) for x in batch.column("docs")[i].values.field("chunks").to_pylist()]
                flat = [{"link": x, "chunk": k, "times": 1} for k, of in enumerate(own) for x in of.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("_row")[i].as_py()], pa.int64()), pa.array([flat], pa.list_(pa.struct([("link", pa.int64()), ("chunk", pa.int32()), ("times", pa.int32())])))], names=["_row", "links"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, ", ".join(f"{n} {kind if n == 'doc_id' else 'string' if n == 'groups_sha256' else 'long'}" for n in names))
    tail = counts.where(F.col("count") < least)
    if not tail.isEmpty():
        more = rows.mapInArrow(rare, "_row long, links array<struct<link: long, chunk: int, times: int>>")
        added = weights(more, tail, most).select("_row", F.inline("sums")).select("_row", F.col("chunk").cast("long").alias("_place"), F.col("n_best").alias("_best"), F.col("count_sum").alias("_sum"))
        plus = lambda c, x: (F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c)
        out = out.join(added, ["_row", "_place"], "left").select(*[plus(n, {"n_best": "_best", "count_sum": "_sum"}[n]) if n in ("n_best", "count_sum") else n for n in names])
    return out.drop("_row", "_place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
