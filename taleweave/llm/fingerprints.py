"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

A document's set is its distinct shingles of five lower-cased words (the whole sequence if it has fewer).
Each shingle is hashed once.  The top bits of the hash name one of `BINS` bins, and a bin keeps the least
hash in it.  An empty bin takes the value of a full bin that is chosen uniformly by a hash of the empty
bin's number and the candidate's, so that documents with the same full bins choose alike: the first `PROBES`
bins in the order of that hash are looked up in a fixed table, and only if all of them are empty are the full
bins hashed and compared.  Only the lowest four bits of each bin are stored, as one hex digit.  Two unrelated bins agree with probability 1/16, so the
likeness of two fingerprints is (agreement - 1/16) / (1 - 1/16), at least 0.

`BINS` sentinels, each the greatest hash of its bin, are sorted together with the shingles' hashes: the first
of each bin is then its minimum, or the sentinel if the bin is empty, without a map or a group-by.

Defined results: a text without words has an empty fingerprint; two empty fingerprints have likeness 1, an
empty and another 0; a null doc_id is the smallest; equal ids are ordered by a hash of their text, and
repeated rows follow each other; texts of any length are read whole; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, durable, join_small, words

BITS = 8
BINS, KEEP_BITS, SHINGLE = 1 << BITS, 4, 5
_LOW = (1 << (64 - BITS)) - 1
#: Bins that an empty bin looks up before it hashes all full ones; this changes the work, never the choice.
PROBES = 16
#: Rows of a sorted run in `with_next`, about, and the quantiles that it cuts the order at.
RUN_ROWS, CUTS = 4096, 256


def _rank(b: Column, j: Column) -> Column:
    """Where bin j stands among the sources of the empty bin b, least first; j stands in the low bits."""
    return F.xxhash64(b, j).bitwiseAND(F.lit(-BINS)).bitwiseOR(j.cast("long"))


def _bin(rank: Column) -> Column:
    return rank.bitwiseAND(F.lit(BINS - 1)).cast("int")


@functools.cache
def _first(spark: SparkSession) -> str:
    """The `PROBES` first sources of each bin, bin after bin: a table of fixed size, as one text that Catalyst folds into one literal."""
    sequence = F.sequence(F.lit(0), F.lit(BINS - 1))
    ranked = F.transform(sequence, lambda b: F.slice(F.sort_array(F.transform(sequence, lambda j: _rank(b, j))), 1, PROBES))
    return spark.range(1).select(F.array_join(F.transform(F.flatten(ranked), _bin).cast("array<string>"), ",")).first()[0]


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`, an array of BINS small numbers, null for a text without words.

    Every step is a column of its own that the next one names more than once: Catalyst would otherwise
    put the step's expression into the lambda and evaluate it again for each element.
    """
    w, h, d, full = f"_{out}_w", f"_{out}_h", f"_{out}_d", f"_{out}_full"
    df = df.withColumn(w, F.transform(words(ascii_lower(F.col(text))), lambda x: F.xxhash64(x)))
    rolled = F.transform(F.col(w), lambda x, i: F.xxhash64(x, *[F.get(F.col(w), i + k) for k in range(1, SHINGLE)]))
    shingles = F.slice(rolled, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
    sentinels = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft((b - BINS // 2).cast("long"), 64 - BITS).bitwiseOR(F.lit(_LOW)))
    df = df.withColumn(h, F.sort_array(F.concat(shingles, sentinels)))
    bin_of = lambda x: F.shiftright(x, 64 - BITS)
    df = df.withColumn(d, F.filter(F.col(h), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(h), i - 1)))))
    df = df.withColumn(d, F.transform(F.col(d), lambda x: F.when(x.bitwiseAND(F.lit(_LOW)) != _LOW, x)))  # null: empty
    df = df.withColumn(full, F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(F.col(d), b).isNotNull()))
    first = F.split(F.lit(_first(df.sparkSession)), ",").cast("array<int>")
    probes = lambda b: [F.get(F.col(d), F.get(first, b * PROBES + k)) for k in range(PROBES)]
    chosen = lambda b: _bin(F.array_min(F.transform(F.col(full), lambda j: _rank(b, j))))
    dense = F.transform(F.col(d), lambda x, b: F.coalesce(x, *probes(b), F.get(F.col(d), chosen(b))).bitwiseAND(F.lit((1 << KEEP_BITS) - 1)).cast("tinyint"))
    return df.withColumn(out, F.when((F.size(w) > 0) & (F.size(full) > 0), dense)).drop(w, h, d, full)


def packed(bins: Column) -> Column:
    """One hex digit for each bin."""
    digits = F.split(F.lit(",".join("0123456789abcdef")), ",")
    return F.coalesce(F.array_join(F.transform(bins, lambda x: F.get(digits, x)), ""), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """Of two columns of bins."""
    same = F.size(F.filter(F.col(a), lambda x, i: x == F.get(F.col(b), i))) / BINS
    chance = 1.0 / (1 << KEEP_BITS)
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def _place(key: Column, frac: Column, cuts: list[int], low: int, high: int) -> Column:
    """Where a key stands in the order, as a number that never falls as the key rises: less than 2 * (cuts + 1).

    A key between two cuts stands in the even stretch between them, as far along as its value is; one that
    equals cuts stands in the odd stretches that these take up, as far along as `frac` says.
    """
    step = max(1, math.isqrt(len(cuts)))
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    whole = array(cuts)
    # cuts below the key, found among every step-th of them and then in that stretch
    coarse = F.size(F.filter(array(cuts[step - 1 :: step]), lambda q: q < key)) * step
    below = coarse + F.size(F.filter(F.slice(whole, coarse + 1, F.lit(step)), lambda q: q < key))
    equal = F.size(F.filter(whole, lambda q: q == key))
    left, right = (F.coalesce(F.get(whole, i), F.lit(x)).cast("double") for i, x in ((below - 1, low), (below, high)))
    along = F.when(right > left, F.least(F.greatest((key.cast("double") - left) / (right - left), F.lit(0.0)), F.lit(1 - 1e-9))).otherwise(F.lit(0.0))
    return F.when(F.get(whole, below) == key, 2 * below + 1 + frac * (2 * equal - 1)).otherwise(2 * below + along)


def with_next(df: DataFrame, key: str, ties: str, carry: list[str]) -> DataFrame:
    """Adds next_<c> of the row with the next smaller key, after the last row that of the first.  Equal keys: by the hash of `ties`.

    A single ordered window would put all rows into one task.  A few quantiles of the key, whatever the size of
    the table, and the stretches between them cut the order into runs instead; rows of one hot key are cut by
    their hash.  A run's last row needs the next run's first: such rows, one a run, are sent to both runs.
    """
    spark = df.sparkSession
    n = df.count()
    if not n:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in carry])
    runs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / RUN_ROWS))
    m = min(CUTS, runs)
    shares = F.array(*[F.lit((i + 0.5) / m) for i in range(m)])
    cuts, low, high = df.agg(F.percentile_approx(key, shares, F.lit(10_000)), F.min(key), F.max(key)).first()
    subs = math.ceil(runs / m)
    hashed = F.xxhash64(ties)
    place = _place(F.col(key), (F.shiftright(hashed, 11) + 2**52) / float(2**53), cuts, low, high)
    df = df.withColumn("_hash", hashed).withColumn("_run", F.floor(place * subs).cast("long"))
    tops = durable(df.groupBy("_run").agg(F.max(F.struct(key, "_hash")).alias("_top")))
    order = Window.orderBy("_run")  # one narrow row a run
    tops = durable(tops.select("_run", F.col("_top")[key].alias("_topkey"), F.col("_top._hash").alias("_top"), F.lead("_run").over(order).alias("_above"), F.min("_run").over(Window.partitionBy()).alias("_lowest")))
    df = join_small(df, tops, ["_run"], "inner")
    own = F.struct(F.col("_run").alias("run"), F.lit(0).alias("tail"))
    first = (F.col(key) == F.col("_topkey")) & (F.col("_hash") == F.col("_top"))
    ahead = F.when(first & F.col("_above").isNotNull(), F.struct(F.col("_above").alias("run"), F.lit(1).alias("tail")))
    around = F.when(first & F.col("_above").isNull(), F.struct(F.col("_lowest").alias("run"), F.lit(2).alias("tail")))
    df = df.withColumn("_at", F.explode(F.array_compact(F.array(own, ahead, around)))).select("*", "_at.run", "_at.tail")
    w = Window.partitionBy("run").orderBy("tail", F.col(key).desc(), F.col("_hash").desc(), ties)
    added = ("_hash", "_run", "_topkey", "_top", "_above", "_lowest", "_at", "run", "tail")
    return df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]).where("tail = 0").drop(*added)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, and the packed bins as `bins`."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_bins(own, "text", "bins").select("doc_id", F.length("text").cast("long").alias("n_chars"), packed(F.col("bins")).alias("fingerprint"), "bins")


def with_edits(docs: DataFrame) -> DataFrame:
    """The contract's table: each document, its edited text, and the likeness of their fingerprints."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("_key"))
    own = with_next(with_bins(own, "text", "bins"), "_key", "text", ["text", "bins"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    own = own.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    own = own.select("doc_id", n.cast("long").alias("n_chars"), "edited", "bins", "next_bins")
    own = with_bins(own, "edited", "edited_bins")
    return own.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness("bins", "edited_bins").alias("near_edited"), likeness("bins", "next_bins").alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
