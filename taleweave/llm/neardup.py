"""MinHash near-duplicates by tensored banding, with every link confirmed on full shingle sets.

Two small collections of `m` bands each, of three minhashes a band, replace one of m*m bands of six: a table
key is a pair of one band of either collection, so 6m minhashes are computed for m*m keys.  Two documents
share a key if some band of the first collection and some band of the second agree; m is the least for
which either fails with probability at most `MISS` at the threshold.

1. One pass over the texts makes each document's set, its digest, its bands and a byte of each minhash
   (numpy, block by block).  Documents with equal sets are one class from here on, with a number of its own.
2. Bands that no other class has are dropped before keys are formed, so most documents form none.
3. A table bucket's pivot is its class that most others share bands with (of a text and its edited copies,
   the text).  Every class is compared with the weightiest pivot of its buckets, so candidates grow with
   the classes, not with the square of a bucket.  Confirmed links join classes into components.
4. Buckets whose classes are now in one component are done: any further link would join nothing.  In a band
   of the others, the classes outside the band's largest component meet all its classes, block by block, and
   those of different components that agree in enough minhash bytes are chained into families.  In a family
   the classes outside its largest component are compared with all others in the same way; pairs go from
   the likest down, and a pair that earlier links have joined is skipped.  So no link between texts is lost
   to pivots, and no list of all pairs is made.
5. Links are joined to trees part by part before labels go round, so what is labelled grows with the classes,
   not with the blocks of a group.

Sets are compared as sorted 64-bit shingle hashes, rebuilt from the texts of candidates only.  A hot pivot's
text is dealt to as many parts as its weight asks for; what belongs to a hot band or family is broadcast after
it was measured, or else salted, and their rows are dealt to blocks.

Defined results: a null text or one without words has an empty set and no links (its component is its own
id); a text with fewer words than a shingle has its whole sequence as its one shingle; a text of any length is
read whole.  Every row is a document and gets a row: rows with one id and equal texts are copies of each other
(all are `kept`, as their id is the component's; `keep_one` keeps one of them), rows with one id and different
texts are linked each by its text.  A row with a null doc_id is linked like others; null is no smallest id, so
its component_id is null only if it reaches no id, and it is kept only then.  An empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import compact, durable, frugal, join_small, pieces, small, without

#: PART: pairs that a part of a pivot has, about.  Groups of up to PACKED rows are packed to PACK_ROWS, about; a task compares TASK_PAIRS.
ROWS_IN_BAND, MISS, BLOCK, PART = 3, 1e-5, 384, 64
PACKED, PACK_ROWS, TASK_PAIRS = 64, 2000, 2_000_000
#: Links that a task joins to trees at once, and the ids that it holds for that, about.
TREES = 400_000


def bands_for(threshold: float) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS_IN_BAND)))


def least_agreement(threshold: float, n: int) -> int:
    """The fewest of n minhash bytes in which documents at the threshold agree, but for a share of MISS."""
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
        if below > MISS:
            return k
    return n


class _Hashes(dict):
    """The hash of a word, remembered; forgotten before it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles.  Bytes are lower-cased and split in ASCII only, as the contract has it."""
    lists = [t.encode("utf-8", "replace").lower().split() if t else [] for t in texts]
    h = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(lists)), np.uint64, sum(map(len, lists)))
    rolled = np.zeros(len(h), np.uint64)
    for j in range(k):
        shifted = np.zeros(len(h), np.uint64)
        shifted[: len(h) - j] = h[j:]
        rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + shifted)
    out, at = [], 0
    for ws in lists:
        n = len(ws)
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            # another kind of hash than that of k words, so that they never meet
            out.append(np.array([xxhash.xxh64_intdigest(b"\0".join(ws), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands(sets: list[np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, 2m): the first collection's bands, then the second's; and a byte of each minhash.  Sets aren't empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.zeros((len(sets), 2 * m), np.uint64)
    low_bytes = np.zeros((len(sets), 2 * m * ROWS_IN_BAND), np.uint8)
    rng = np.random.default_rng(20240229)
    # the shingles' hashes are mixed already: an odd factor and a summand put them into another order
    factors = rng.integers(0, 2**32, size=(2 * m, ROWS_IN_BAND), dtype=np.uint32) | np.uint32(1)
    summands = rng.integers(0, 2**32, size=(2 * m, ROWS_IN_BAND), dtype=np.uint32)
    x = np.empty_like(flat)
    for b in range(2 * m):
        for r in range(ROWS_IN_BAND):
            np.multiply(flat, factors[b, r], out=x)
            np.add(x, summands[b, r], out=x)
            low = np.minimum.reduceat(x, starts).astype(np.uint64)
            low_bytes[:, b * ROWS_IN_BAND + r] = _mix(low) & np.uint64(255)
            out[:, b] = _mix(out[:, b] * np.uint64(0x9E3779B97F4A7C15) + low)
    return out, low_bytes


def sketch(docs: DataFrame, shingle: int, m: int) -> DataFrame:
    """row (what tells a text among its id's), doc_id, n_shingles, digest (null for an empty set), bands, low (a byte of each minhash)."""

    def run(batches):
        for batch in small(batches, "text"):
            ids, rows, texts = batch.column("doc_id"), batch.column("row"), batch.column("text").to_pylist()
            for a, b in pieces(texts):
                sets = shingle_sets(texts[a:b], shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                digests: list = [None] * len(sets)
                lows: list = [None] * len(sets)
                if full:
                    found, low = bands([sets[i] for i in full], m)
                    for i, row, own in zip(full, found.view(np.int64), low, strict=True):
                        keys[i], lows[i], digests[i] = row, own.tobytes(), hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(a, b - a), ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(lows, pa.binary())],
                    names=["row", "doc_id", "n_shingles", "digest", "bands", "low"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row decimal(38,0), doc_id {kind}, n_shingles long, digest binary, bands array<long>, low binary")


def keyed(classes: DataFrame, m: int) -> DataFrame:
    """key, id, weight: the table keys of the classes that share bands of both collections with other classes.

    weight: how many classes share the class's bands, all told.
    """
    rows = classes.select("id", F.posexplode("bands").alias("band", "value"))
    shared = rows.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    own = rows.join(shared, ["band", "value"]).groupBy("id").agg(F.collect_list(F.struct("band", "value")).alias("b"), F.sum("n").alias("weight"))
    first, second = F.filter("b", lambda x: x["band"] < m), F.filter("b", lambda x: x["band"] >= m)
    pairs = own.select("id", "weight", F.explode(first).alias("x"), second.alias("second")).select("id", "weight", "x", F.explode("second").alias("y"))
    keys = pairs.select(F.xxhash64("x.band", "x.value", "y.band", "y.value").alias("key"), "id", "weight")
    alone = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key")
    return keys.join(alone, "key")


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (id, pivot) whose sets have 100 * intersection >= percent * union, as a, b.  texts: id, text.

    pairs: id, pivot, parts.  A pivot's text goes to its parts only, each of which has few of its pairs.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    pivots = dealt.select("pivot", "part").distinct().join(texts.withColumnsRenamed({"id": "pivot", "text": "right"}), "pivot")
    wide = dealt.join(texts.withColumnRenamed("text", "left"), "id").join(pivots, ["pivot", "part"]).withColumnsRenamed({"id": "a", "pivot": "b"})

    def run(batches):
        for batch in small(batches, "left"):
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            keep = np.zeros(len(left), bool)
            for s, e in pieces([x + y for x, y in zip(left, right, strict=True)]):
                distinct = {t: i for i, t in enumerate(dict.fromkeys(left[s:e] + right[s:e]))}
                sets = shingle_sets(list(distinct), shingle)
                for i in range(s, e):
                    keep[i] = _linked(sets[distinct[left[i]]], sets[distinct[right[i]]], percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return wide.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def forest(links: DataFrame) -> DataFrame:
    """Links a, b that join what the given ones join: in each partition (at most `TREES` ids at once) one for each id but the least of a tree."""

    def stars(joined: _Union) -> pa.RecordBatch:
        found = [(root, x) for x in joined if (root := joined.find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        joined = _Union()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                p, q = joined.find(a), joined.find(b)
                if p != q:
                    joined[max(p, q)] = min(p, q)
            if len(joined) > TREES:
                yield stars(joined)
                joined = _Union()
        yield stars(joined)

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def trees(links: DataFrame) -> DataFrame:
    """A forest of all links, or of each of few parts: blocks of one group give many links for an id, of which no more than one a part is left."""
    links = compact(forest(links).distinct(), TREES)
    n = links.count()
    while links.rdd.getNumPartitions() > 1 or n > TREES:
        fewer = compact(forest(links).distinct(), TREES)
        before, n, links = n, fewer.count(), fewer
        if 2 * n > before:
            return links
    return compact(forest(links))


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of all ids with links.  links: a, b.

    Every round a vertex takes the least label around it, and then its label's label, so long chains
    shrink fast.  Labels are kept on disk between rounds; only a count comes to the driver.
    """
    links = trees(links)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = compact(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        near = both.join(now.select(F.col("id").alias("b"), "component"), "b").select(F.col("a").alias("id"), "component", F.lit(None).cast("long").alias("old"))
        own = now.select("id", "component", F.col("component").alias("old"))
        step = compact(near.unionByName(own).groupBy("id").agg(F.min("component").alias("component"), F.max("old").alias("old")))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("next"))
        step = compact(step.join(jump, "component").select("id", "old", F.least("component", "next").alias("component")))
        changed = not step.where("old <> component").isEmpty()
        now = step.select("id", "component")
        if not changed:
            return now


def _open_ids(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """id, component of the classes in buckets with more than one component.  rows: key, id."""
    named = rows.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    several = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return named.join(several, "key").select("id", "component").distinct()


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in column), np.uint8).reshape(len(column), -1)


class _Union(dict):
    def find(self, x):
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x


def _blocked(rows: DataFrame, size_of: str, some: DataFrame) -> DataFrame:
    """Rows of a group dealt to pairs of blocks: side 0 holds `some`, side 1 all.  size_of: the group's row count."""
    block = lambda n: F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / BLOCK)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), (F.ceil(F.col(n) / BLOCK) - 1).cast("int"))
    left = some.withColumn("i", block("few")).withColumn("j", F.explode(upto(size_of)))
    right = rows.withColumn("j", block(size_of)).withColumn("i", F.explode(upto("few")))
    return left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))


def _chained(like: np.ndarray) -> np.ndarray:
    """For the rows and then the columns of a matrix of likely pairs: the first row that chains of them reach, -1 for none."""
    n, k = like.shape
    rows, columns = np.full(n, -1), np.full(k, -1)
    for start in range(n):
        new = np.zeros(n, bool)
        new[start] = rows[start] < 0 and like[start].any()
        while new.any():
            rows[new] = start
            there = like[new].any(axis=0) & (columns < 0)
            columns[there] = start
            new = like[:, there].any(axis=1) & (rows < 0)
    return np.concatenate([rows, columns])


def _uneven(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups with several components: their largest one, their rows, and the rows outside of it."""
    counts = rows.groupBy(*by, "component").agg(F.count("*").alias("n"))
    most = counts.groupBy(*by).agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("components")).where("components > 1")
    return most.select(*by, F.col("m.component").alias("main"), "n", (F.col("n") - F.col("m.n")).alias("few"))


def families(ids: DataFrame, classes: DataFrame, m: int, least: int) -> DataFrame:
    """id, component, family of open classes that chains of likely links join across components.

    Of the classes with a band of the first collection in common, those outside the band's largest component
    meet all others in blocks of bounded size; only a chain of the likely links leaves a block, not its pairs.
    """
    own = ids.join(classes, "id").select("id", "component", "low", F.posexplode(F.slice("bands", 1, m)).alias("band", "value"))
    sizes = compact(_uneven(own, ["band", "value"]))
    rows = join_small(own, sizes, ["band", "value"], "inner", F.xxhash64("id"))
    # small groups go to Python many at once, and what takes long to compare isn't put into few tasks for its few bytes
    packs, work = sizes.agg(F.ceil(F.sum(F.when(F.col("n") <= PACKED, F.col("n"))) / PACK_ROWS), F.ceil(F.sum(F.col("n") * F.col("few")) / TASK_PAIRS)).first()
    own_key = F.xxhash64("band", "value")
    pack = F.when(F.col("n") <= PACKED, F.pmod(own_key, F.lit(max(1, packs or 0)))).otherwise(own_key)
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), work or 1)
    dealt = _blocked(rows, "n", rows.where("component <> main")).withColumn("pack", pack).repartition(parts, "pack", "i", "j")

    def chained(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        like = _agreement(_bytes(a["low"]), _bytes(b["low"])) >= least
        like &= a["component"].to_numpy()[:, None] != b["component"].to_numpy()[None]
        ids = np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()])
        label = _chained(like)
        tied = np.flatnonzero((label >= 0) & (label != np.arange(len(ids))))
        return ids[tied], ids[label[tied]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["band", "value", "side"], kind="stable")
        group = np.flatnonzero(np.diff(pdf["value"].to_numpy(), prepend=0).astype(bool) | np.diff(pdf["band"].to_numpy(), prepend=-1).astype(bool))
        side = pdf["side"].to_numpy()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for start, stop in zip(group, [*group[1:], len(pdf)], strict=True):
            middle = start + int(np.searchsorted(side[start:stop], 1))
            if start < middle < stop:
                out.append(chained(pdf.iloc[start:middle], pdf.iloc[middle:stop]))
        return pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([x for _, x in out])})

    chains = dealt.groupBy("pack", "i", "j").applyInPandas(run, "a long, b long")
    found = components(chains).withColumnRenamed("component", "family")
    return ids.join(found, "id")


def settle(members: DataFrame, texts: DataFrame, classes: DataFrame, shingle: int, percent: int, least: int) -> DataFrame:
    """Confirmed links a, b between the components of each family.  members: id, component, family."""
    most = compact(_uneven(members, ["family"]))
    rows = join_small(members, most, ["family"], "inner", F.xxhash64("id"))
    rows = durable(rows.join(classes.select("id", "low"), "id").join(texts, "id"))
    dealt = _blocked(rows, "n", rows.where("component <> main"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []})
        agree = _agreement(_bytes(a["low"]), _bytes(b["low"]))
        left, right = a["component"].to_numpy(), b["component"].to_numpy()
        likely = np.argwhere((agree >= least) & (left[:, None] != right[None]))
        likely = likely[np.argsort(-agree[likely[:, 0], likely[:, 1]], kind="stable")]
        sets_a, sets_b = shingle_sets(a["text"].tolist(), shingle), shingle_sets(b["text"].tolist(), shingle)
        joined, out = _Union(), []
        for i, j in likely:
            p, q = joined.find(left[i]), joined.find(right[j])
            if p != q and _linked(sets_a[i], sets_b[j], percent):
                joined[max(p, q)] = min(p, q)
                out.append((a["id"].iloc[i], b["id"].iloc[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return dealt.groupBy("family", "i", "j").applyInPandas(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _row() -> Column:
    """128 bits that tell a text among those of one id, nulls too."""
    high, low = (F.xxhash64(F.lit(i), "text").cast("decimal(20,0)") for i in (1, 2))
    return (high * F.lit(2**62).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def link(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept, first, and what tells the row's text, for every document.

    class_id is the smallest id with the same set.  first: the component's smallest row, if it has an id.
    """
    m = bands_for(percent / 100)
    least = least_agreement(percent / 100, 2 * m * ROWS_IN_BAND)
    own = frugal(docs).select(_row().alias("row"), "doc_id", "text")
    sketched = durable(sketch(own, shingle, m))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = F.min_by(F.struct("bands", "low"), place)
    groups = sketched.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(place).alias("place"), first.alias("s"))
    # a number for each class: the checkpoint keeps it
    classes = durable(groups.select(F.monotonically_increasing_id().alias("id"), "digest", "place", "s.bands", "s.low"))
    rows = durable(keyed(classes.select("id", "bands"), m))
    labels = classes.select("id", F.col("id").alias("component"))
    if not rows.isEmpty():
        wanted = classes.join(rows.select("id").distinct(), "id", "left_semi").select("id", "place.doc_id", "place.row")
        same = own["doc_id"].eqNullSafe(wanted["doc_id"]) & (own["row"] == wanted["row"])
        texts = durable(own.join(wanted, same).groupBy("id").agg(F.min("text").alias("text")))
        pivots = rows.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("p")).select("key", F.col("p.weight").alias("heft"), (-F.col("p.minus")).alias("pivot"))
        # a class is compared with the weightiest pivot of its buckets only: what that leaves open is settled below
        best = rows.join(pivots, "key").where("id <> pivot").groupBy("id").agg(F.max(F.struct("heft", (-F.col("pivot")).alias("minus"))).alias("p"))
        # a pivot shares each of its 2m bands with at most heft classes, all told
        pairs = best.select("id", (-F.col("p.minus")).alias("pivot"), F.ceil(F.col("p.heft") / (2 * m * PART)).alias("parts"))
        links = compact(confirm(pairs, texts, shingle, percent))
        labels = components(links)
        ids = compact(_open_ids(rows.select("key", "id"), labels))
        if not ids.isEmpty():
            members = compact(families(ids, classes.select("id", "bands", "low"), m, least))
            more = compact(settle(members, texts, classes, shingle, percent, least))
            if not more.isEmpty():
                labels = components(links.unionByName(more))
    named = classes.select("id", "digest", "place").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = named.groupBy("component").agg(F.min("place").alias("lowest"))
    named = named.join(lowest, "component").select("digest", F.col("place.doc_id").alias("class_id"), "lowest")
    out = sketched.drop("bands", "low").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("lowest.doc_id"))
    class_id = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    is_first = F.col("digest").isNull() | (F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("row") == F.col("lowest.row")))
    return out.select("doc_id", "n_shingles", class_id.alias("class_id"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), is_first.alias("first"), "row", F.col("digest").isNull().alias("empty"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all its columns: of its smallest id, and of such repeated rows one.  Documents without words stay, all of them."""
    found = durable(link(docs, shingle, percent))
    plain = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1 OR doc_id IS NULL").isEmpty()
    if plain:
        return without(docs, durable(found.where("NOT kept").select("doc_id")))
    # rows that share an id are told apart by their text, at the price of a shuffle
    told = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").alias("id"), _row().alias("row"))
    stay = found.where("first").select(F.col("doc_id").alias("id2"), F.col("row").alias("row2"), "empty").distinct()
    kept = told.join(stay, F.col("id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")))
    return kept.where("NOT empty").dropDuplicates(["id", "row"]).unionByName(kept.where("empty")).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM worded),
classes AS (SELECT min(doc_id) AS id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
items AS (SELECT id, len(s) AS n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id, id AS r FROM classes UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
labels AS (SELECT id, min(r) AS component FROM reach GROUP BY id)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(l.component, t.doc_id) AS component_id, t.doc_id = coalesce(l.component, t.doc_id) AS kept
FROM sets t LEFT JOIN classes c ON list_sort(t.s) = c.s LEFT JOIN labels l ON l.id = c.id
"""
