"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of the words in proportion to its weight, at most `max_copies` times what it
has; what a capped source cannot use goes to the others by weight.  A document's expected copies are its
source's target over its source's size (times its own relative weight, if a weight column is given).
The whole part is certain.  The fraction p is sampled: with u uniform from the id's hash, documents are
ranked by the random odds u/(1-u) over the inclusion odds p/(1-p), and the first of the order are taken
until the source's remaining words are used.  One closing document, the one whose size is nearest the
gap that is left, brings the words close to the target.

The rank is a running sum.  It isn't computed in one task for a source: each source's order is cut into
about sqrt(n) buckets, whose sums are summed first, so that a hot source is spread over the cluster.

Defined results: a null text has size 0; a null source is a source of its own and comes last; rows with
equal ids have equal random numbers and are ranked by size (and, alike in size too, close a source together);
a text of any length is counted whole; an empty table gives an empty result; other columns are ignored by `mix`,
whatever their names, and kept by `expand`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, join_small, words


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: float = 3.0) -> DataFrame:
    """One row a source: skey, source_size, n, target.  sized: skey, source, size.

    Sorted by cap over weight, the level (words for each unit of weight) rises while sources reach their
    cap and falls after it, so the final level is the greatest.  One row for each source is all the
    window sees: sources are the named parts of a mixture, not a quantity that grows with documents.
    """
    sums = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    cap_before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    w_from = F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    return (
        sums.withColumn("w", w)
        .withColumn("cap", F.lit(float(max_copies)) * F.col("source_size"))
        .withColumn("level", (F.sum("source_size").over(every).cast("double") - cap_before) / w_from)
        .withColumn("target", F.least(F.col("cap"), F.col("w") * F.max("level").over(every)))
        .select("skey", "source_size", "n", "target")
    )


def _random(seed: str) -> Column:
    """u in (0, 1), from the id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def _skey() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))


def _own(weight: str | None) -> Column:
    return F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)


def _placed(rows: DataFrame, max_copies: float) -> DataFrame:
    """Adds rate, whole and odds to rows that have source_size, target, mean, own and u.  odds is null without a fraction."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    expected = F.when(F.col("mean") > 0, F.least(F.lit(float(max_copies)), F.col("rate") * F.col("own") / F.col("mean"))).otherwise(0.0)
    fraction = F.col("expected") - F.col("whole")
    rows = rows.withColumn("rate", rate).withColumn("expected", expected).withColumn("whole", F.floor("expected"))
    return rows.withColumn("odds", F.when(fraction > 0, (F.col("u") / (1 - F.col("u"))) * ((1 - fraction) / fraction))).drop("expected")


class Mixture:
    """rows: every document with its place in its source's order.  sources: one row for each source, with its cut.

    A fractional copy is taken up to the cut (odds, doc_id, size), and for the closing document.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: float = 3.0, seed: str = "mix", weight: str | None = None):
        self.max_copies, self.seed, self.weight = max_copies, seed, weight
        sized = durable(docs.select("doc_id", "source", _skey().alias("skey"), F.size(words(F.col("text"))).cast("long").alias("size"), _random(seed).alias("u"), _own(weight).alias("own")))
        targets = source_targets(sized, weights, max_copies)
        if weight:
            targets = targets.join(sized.groupBy("skey").agg((F.sum(F.col("own") * F.col("size")) / F.sum("size")).alias("mean")), "skey")
        else:
            targets = targets.withColumn("mean", F.lit(1.0))
        targets = durable(targets)
        # buckets of the order: by u where all odds of a source are alike, and by the same measure where not
        rows = _placed(join_small(sized, targets, ["skey"]), max_copies)
        rows = (
            rows.withColumn("part", F.when(F.col("odds").isNull(), F.lit(0)).otherwise(F.col("size")))
            .withColumn("buckets", F.ceil(F.sqrt("n")))
            .withColumn("mid", F.least(F.greatest(F.col("rate") - F.floor("rate"), F.lit(1e-9)), F.lit(1 - 1e-9)))
            .withColumn("rank", F.col("odds") * (F.col("mid") / (1 - F.col("mid"))))
            .withColumn("bucket", F.coalesce(F.least(F.col("buckets") - 1, F.floor(F.col("buckets") * (F.col("rank") / (1 + F.col("rank"))))), (F.col("buckets") * F.col("u")).cast("long")))
            .drop("mid", "rank", "buckets", "n", "mean", "own", "u", "rate")
        )
        sums = rows.groupBy("skey", "bucket").agg(F.sum("part").alias("part"), F.sum(F.col("whole") * F.col("size")).alias("certain"))
        before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("skey", "bucket", F.coalesce(F.sum("part").over(before), F.lit(0)).alias("ahead"), F.sum("certain").over(Window.partitionBy("skey")).alias("certain"))
        within = Window.partitionBy("skey", "bucket").orderBy(F.col("odds").asc_nulls_last(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        self.rows = durable(
            rows.join(sums, ["skey", "bucket"])
            .withColumn("left", F.col("target") - F.col("certain"))
            .withColumn("through", F.col("ahead") + F.sum("part").over(within))
            .withColumn("chosen", F.col("odds").isNotNull() & (F.col("through") <= F.col("left")))
            .drop("ahead", "certain", "bucket")
        )
        place = F.struct("odds", "doc_id", "size")
        taken = F.coalesce(F.max(F.when(F.col("chosen"), F.col("through"))), F.lit(0))
        cuts = durable(self.rows.groupBy("skey").agg((F.max("left") - taken).alias("gap"), F.max(F.when(F.col("chosen"), place)).alias("cut")))
        off = F.abs(F.col("size") - F.col("gap"))
        closing = (
            join_small(self.rows.where(F.col("odds").isNotNull() & ~F.col("chosen")), cuts, ["skey"])
            .where(off < F.col("gap"))
            .groupBy("skey")
            .agg(F.min(F.struct(off.alias("off"), "odds", F.col("doc_id").alias("id"), F.col("size").alias("size"))).alias("closing"))
        )
        self.sources = durable(targets.select("skey", "source_size", "target", "mean").join(cuts.select("skey", "cut"), "skey").join(closing, "skey", "left"))

    def _copies(self, size: Column) -> Column:
        # the size is looked at only where id and odds are tied
        cut, closing = F.col("cut"), F.col("closing")
        earlier = (F.col("odds") < cut["odds"]) | ((F.col("odds") == cut["odds"]) & (F.struct("doc_id", size) <= F.struct(cut["doc_id"], cut["size"])))
        closes = F.col("doc_id").eqNullSafe(closing["id"]) & (F.col("odds") == closing["odds"]) & (size == closing["size"])
        extra = F.col("odds").isNotNull() & (F.coalesce(earlier, F.lit(False)) | F.coalesce(closes, F.lit(False)))
        return (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("long")

    def table(self) -> DataFrame:
        """doc_id, source, size, source_size, target, copies, taken for every document."""
        out = join_small(self.rows.drop("source_size", "target"), self.sources, ["skey"]).withColumn("copies", self._copies(F.col("size")))
        return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))

    def expand(self, docs: DataFrame) -> DataFrame:
        """The documents as the mixture holds them, each as often as its copies say, in one pass: no text is shuffled."""
        columns = docs.columns
        named = docs.select(F.struct(*columns).alias("row"), "doc_id", "text", _skey().alias("skey"), _random(self.seed).alias("u"), _own(self.weight).alias("own"))
        placed = _placed(join_small(named, self.sources, ["skey"]), self.max_copies)
        copies = placed.withColumn("copies", self._copies(F.size(words(F.col("text"))).cast("long"))).where("copies > 0")
        return copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: float = 3.0, seed: str = "mix", weight: str | None = None) -> DataFrame:
    return Mixture(docs, weights, max_copies, seed, weight).table()


def query(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3.0::DOUBLE * source_size AS cap FROM sums),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM levels),
rated AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
odds AS (
  SELECT *, CAST(floor(rate) AS BIGINT) AS whole,
         CASE WHEN rate - floor(rate) > 0 THEN (u / (1 - u)) * ((1 - (rate - floor(rate))) / (rate - floor(rate))) END AS odds FROM rated),
ranked AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS remaining,
         sum(CASE WHEN odds IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS through
  FROM odds),
chosen AS (SELECT *, odds IS NOT NULL AND through <= remaining AS chosen FROM ranked),
gaps AS (SELECT *, max(remaining) OVER (PARTITION BY source) - coalesce(max(CASE WHEN chosen THEN through END) OVER (PARTITION BY source), 0) AS gap FROM chosen),
closing AS (
  SELECT *, CASE WHEN NOT chosen AND odds IS NOT NULL AND abs(size - gap) < gap
                 THEN row_number() OVER (PARTITION BY source, (NOT chosen AND odds IS NOT NULL AND abs(size - gap) < gap) ORDER BY abs(size - gap), odds, doc_id) END AS place
  FROM gaps)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN chosen OR coalesce(place = 1, false) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM closing
"""
