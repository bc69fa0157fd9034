"""Exact joins of similar and of contained texts that form no pair without a shared key.

Jaccard: sets are ordered by how rare their members are.  Two sets with a likeness above t share a member among the first
|x| - ceil(t |x|) + 1 of each, so only those prefixes meet, and only where the sizes allow the likeness.
Where sets are of common members (trigrams of long texts), prefixes meet nearly all others: `longest_alike` then compares parts
of a block as products of matrices and keeps one row of each set, so that neither memory nor disk grows with the pairs.
Containment: a text that stands inside another brings all its runs of characters along, and of each window of runs the least
by a hash.  A long text's rarest such run is its one key, which meets the least runs of other texts; a short text's key is its
rarest run of the longest q that it has, and meets all runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..session import durable

#: Lengths of a short contained text's key; the longest that fits is taken.
RUNS = (12, 3, 1)
#: Characters of a long text's runs, and runs of a window of which the least is kept.
RUN, WINDOW = 12, 36
#: So many keys of short texts, once counted, go to the texts; more are met by a shuffle.
BROADCAST_ROWS = 100_000
#: Sets of a part, and of a side of one product: a task holds two parts.
ROWS, STEP = 8192, 1024


def _frequencies(rows: DataFrame, member: str) -> DataFrame:
    return rows.groupBy("block", member).agg(F.count(F.lit(1)).alias("df"))


def jaccard_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """l, r, like of pairs of one block whose likeness is above `least` (and above 0).

    left, right: id, block, grams (an array of distinct members).  Sets without members are like nothing.
    """
    both = left.select(F.lit(0).alias("side"), "id", "block", "grams").unionByName(right.select(F.lit(1).alias("side"), "id", "block", "grams")).where(F.size("grams") > 0)
    each = both.select("side", "id", "block", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    df = _frequencies(each, "gram")
    ordered = each.join(df, ["block", "gram"]).groupBy("side", "id", "block", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    width = F.col("n") - F.greatest(F.ceil(F.col("n") * F.lit(least) - 1e-9), F.lit(1)) + 1
    prefix = durable(ordered.select("side", "id", "block", "n", F.explode(F.transform(F.slice("g", F.lit(1), width.cast("int")), lambda x: x["gram"])).alias("gram")))
    a = prefix.where("side = 0").select("block", "gram", F.col("id").alias("l"), F.col("n").alias("ln"))
    b = prefix.where("side = 1").select("block", "gram", F.col("id").alias("r"), F.col("n").alias("rn"))
    fits = F.least("ln", "rn") > F.greatest("ln", "rn") * F.lit(least) - 1e-9
    pairs = a.join(b, ["block", "gram"]).where(fits).select("block", "l", "r").distinct()
    x, y = left.select("block", F.col("id").alias("l"), F.col("grams").alias("_x")), right.select("block", F.col("id").alias("r"), F.col("grams").alias("_y"))
    common = F.size(F.array_intersect("_x", "_y"))
    like = F.round(common / (F.size("_x") + F.size("_y") - common), 9)
    return pairs.join(x, ["block", "l"]).join(y, ["block", "r"]).select("l", "r", like.alias("like")).where(F.col("like") > least)


def runs(text: Column, q: int) -> Column:
    """Distinct runs of q characters, in one pass; none if the text is shorter."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


@F.arrow_udf(ArrayType(LongType()))
def _least_runs(texts: pa.Array) -> pa.Array:
    """The least hash of each window of runs; none of texts shorter than a window."""
    found, ends = [np.zeros(0, np.int64)], [0]
    for t in texts.to_pylist():
        codes = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(codes) >= RUN + WINDOW - 1:
            h = np.zeros(len(codes) - RUN + 1, np.uint64)
            for i in range(RUN):
                h = h * np.uint64(1099511628211) + codes[i : len(codes) - RUN + 1 + i]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            found.append(np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1)).view(np.int64))
            ends.append(ends[-1] + len(found[-1]))
        else:
            ends.append(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))


def contained_pairs(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """o, i of pairs of one block where the inner text stands inside the outer one (or equals it).

    outer, inner: id, block, text without nulls.  An empty text stands inside all of its block.
    """
    size = F.length("text")
    long = size >= RUN + WINDOW - 1
    own = durable(inner.where(long).select("id", "block", F.explode(_least_runs("text")).alias("run")))
    keys = own.join(_frequencies(own, "run"), ["block", "run"]).groupBy("id", "block").agg(F.min(F.struct("df", "run")).alias("k")).select(F.col("id").alias("i"), "block", "k.run")
    offered = outer.where(long).select(F.col("id").alias("o"), "block", F.explode(_least_runs("text")).alias("run"))
    pairs = offered.join(keys, ["block", "run"]).select("block", "o", "i")

    q = F.lit(0)
    for n in reversed(RUNS):
        q = F.when(size >= n, n).otherwise(q)
    short = inner.where(~long).withColumn("q", q)
    grams = F.lit(None).cast("array<string>")
    for n in RUNS:
        grams = F.when(F.col("q") == n, runs(F.col("text"), n)).otherwise(grams)
    own = durable(short.select("id", "block", "q", F.explode(F.coalesce(grams, F.array(F.lit("")))).alias("run")))
    df = own.groupBy("block", "q", "run").agg(F.count(F.lit(1)).alias("df"))
    wanted = durable(own.join(df, ["block", "q", "run"]).groupBy("id", "block", "q").agg(F.min(F.struct("df", "run")).alias("k")).select(F.col("id").alias("i"), "block", "q", "k.run"))
    if few := wanted.count():
        classes = [r[0] for r in wanted.select("q").distinct().collect()]
        each = [F.struct(F.lit(n).alias("q"), (runs(F.col("text"), n) if n else F.array(F.lit(""))).alias("runs")) for n in sorted(classes)]
        said = outer.select("id", "block", F.explode(F.array(*each)).alias("s")).select(F.col("id").alias("o"), "block", "s.q", F.explode("s.runs").alias("run"))
        pairs = pairs.unionByName(said.join(F.broadcast(wanted) if few <= BROADCAST_ROWS else wanted, ["block", "q", "run"]).select("block", "o", "i"))
    x, y = outer.select("block", F.col("id").alias("o"), F.col("text").alias("_x")), inner.select("block", F.col("id").alias("i"), F.col("text").alias("_y"))
    return pairs.join(x, ["block", "o"]).join(y, ["block", "i"]).where(F.contains("_x", "_y")).select("o", "i")


_CODE = np.zeros(128, np.uint16)
_CODE[ord("0") : ord("9") + 1], _CODE[ord("a") : ord("z") + 1] = np.arange(1, 11), np.arange(11, 37)
_OTHER = r"[^a-z0-9]+"


@F.arrow_udf(BinaryType())
def trigram_codes(texts: pa.Array) -> pa.Array:
    """The distinct trigrams (see `relevance.trigrams`) of lower-cased texts, each as a 16-bit number."""
    out = []
    for t in texts.to_pylist():
        c = _CODE[np.frombuffer(t.encode("ascii"), np.uint8)]
        code = c[:-2] * np.uint16(37 * 37) + c[1:-1] * np.uint16(37) + c[2:]
        out.append(np.unique(code[(c[1:-1] > 0) | (c[2:] > 0)]).tobytes())
    return pa.array(out, pa.binary())


def codes(lowered: Column) -> Column:
    """Of each word's trigrams, padded by two blanks before and one after: none spans two words."""
    return trigram_codes(F.concat(F.lit("  "), F.regexp_replace(lowered, _OTHER, "  "), F.lit("  ")))


def _parted(rows: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their part of the block, and the block's number of parts."""
    parts = rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias(f"{side}s"))
    return rows.join(F.broadcast(parts), "block").withColumn(side, F.pmod(F.xxhash64("id"), F.col(f"{side}s")).cast("int")), parts


def longest_alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """l, r, n, like: of each left set the right one of its block, not itself, with the greatest n among those whose likeness (Jaccard) is above `least`;
    of several the likest, then the smallest id.  A row for each part that has one.

    left, right: id (string), block, codes; right also n.
    """
    a, ours = _parted(left.select("id", "block", "codes"), "lp")
    b, theirs = _parted(right.select("id", "block", "codes", "n"), "rp")
    a = a.join(F.broadcast(theirs), "block").withColumn("rp", F.explode(F.sequence(F.lit(0), F.col("rps") - 1))).select("block", "lp", "rp", "id", "codes")
    b = b.join(F.broadcast(ours), "block").withColumn("lp", F.explode(F.sequence(F.lit(0), F.col("lps") - 1))).select("block", "lp", "rp", "id", "codes", "n")
    limit = round(least * 1e9)
    kind = left.schema["id"].dataType
    schema = StructType([StructField("l", kind), StructField("r", kind), StructField("n", LongType()), StructField("like", LongType())])

    def sets(rows: pa.Table, order: list) -> tuple[pa.Table, list[np.ndarray]]:
        rows = rows.sort_by(order)
        return rows, [np.frombuffer(x, np.uint16) for x in rows["codes"].to_pylist()]

    def dense(own: list[np.ndarray], place: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(own), width), np.float32)
        at = place[np.concatenate(own)] if own else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(own)), [len(x) for x in own])
        out[row[at >= 0], at[at >= 0]] = 1
        return out

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        x, xs = sets(x, [("id", "ascending")])
        y, ys = sets(y, [("n", "descending"), ("id", "ascending")])
        found = []
        if xs and ys:
            shared = np.intersect1d(np.unique(np.concatenate(xs)), np.unique(np.concatenate(ys)))
            place = np.full(1 << 16, -1, np.int64)
            place[shared] = np.arange(len(shared))
            xid, yid, n = np.array(x["id"].to_pylist(), object), np.array(y["id"].to_pylist(), object), np.array(y["n"].to_pylist(), np.int64)
            xn, yn = np.array([len(s) for s in xs]), np.array([len(s) for s in ys])
            for i in range(0, len(xs), STEP):
                one = dense(xs[i : i + STEP], place, len(shared))
                best = np.full((len(one), 3), -1, np.int64)  # n, like, row
                for j in range(0, len(ys), STEP):
                    to = slice(j, j + STEP)
                    open_ = np.flatnonzero(best[:, 0] <= n[j])  # a longer one is better whatever else there is
                    if not len(open_):
                        break
                    common = (one[open_] @ dense(ys[to], place, len(shared)).T).astype(np.float64)
                    union = xn[i + open_][:, None] + yn[to][None, :] - common
                    like = np.floor(common * 1e9 / np.maximum(union, 1) + 0.5).astype(np.int64)
                    ok = (like > limit) & (xid[i + open_][:, None] != yid[to][None, :])
                    hit = ok.any(axis=1)
                    ok, like, open_ = ok[hit], like[hit], open_[hit]
                    most = np.where(ok, n[to][None, :], -1).max(axis=1)
                    like = np.where(ok & (n[to][None, :] == most[:, None]), like, -1)
                    at = like.argmax(axis=1)  # the first of equals has the smallest id
                    top = like[np.arange(len(at)), at]
                    better = (most > best[open_, 0]) | ((most == best[open_, 0]) & (top > best[open_, 1]))
                    best[open_[better]] = np.stack([most[better], top[better], j + at[better]], axis=1)
                found += [(xid[i + k], yid[best[k, 2]], int(best[k, 0]), int(best[k, 1])) for k in np.flatnonzero(best[:, 2] >= 0)]
        return pa.table({c: pa.array([f[k] for f in found], kind) for k, (c, kind) in enumerate((("l", x.schema.field("id").type), ("r", x.schema.field("id").type), ("n", pa.int64()), ("like", pa.int64())))})

    fresh = lambda rows: rows.select(*[F.col(c).alias(c) for c in rows.columns])  # noqa: E731  # both sides may come from one table
    by = ["block", "lp", "rp"]
    met = fresh(a).groupBy(*by).cogroup(fresh(b).groupBy(*by)).applyInArrow(compare, schema)
    return met.withColumn("like", F.col("like") / F.lit(1e9))
