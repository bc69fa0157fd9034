"""URL filters: rules by host and path, and trust that spreads over the link graph.

A page's url is judged by the longest rule that fits.  Where none fits, its host is judged: trust starts
at hosts in proportion to the share of their pages that a rule allows, and follows links (personalised
PageRank); distrust starts at the share that a rule blocks, and follows links backwards, from a page's
target to the page that links to it.  A host whose distrust exceeds its trust by the threshold, counted
in shares of pages, is blocked.

Defined results: a url that is null or has no `://` has an empty host and path, fits no rule and belongs
to no host, so it is allowed; a null html has no links; urls and pages of any length are read whole; repeated
rows count as often as they stand there; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, durable, join_small

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""
#: Fixed values of the contract.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.5
#: No host's trust or distrust changes by more in the last round.  `ROUNDS` is what the SQL stops after.
TOLERANCE, EVERY = 1e-9, 6


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does.  Of equal lengths a blocking rule wins."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block", r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, links: links between different hosts, counted before they are shuffled by target."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.filter(targets, lambda x: x.contains("//"))).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    found = found.select("src", host_of(to).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(shares: DataFrame, links: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust after the given rounds, or else when they have settled.  shares: host, allowed, blocked (shares of its pages)."""
    links = durable(links)
    shares = durable(shares)
    start = shares.select("host", (F.col("allowed") * (1 - damping)).alias("trust"), (F.col("blocked") * (1 - damping)).alias("distrust"))
    if links.isEmpty():
        return start
    ends = links.groupBy(F.col("src").alias("host")).agg(F.sum("links").alias("n"))
    begins = links.groupBy(F.col("dst").alias("host")).agg(F.sum("links").alias("n"))
    edges = links.join(ends.select(F.col("host").alias("src"), F.col("n").alias("outs")), "src").join(begins.select(F.col("host").alias("dst"), F.col("n").alias("ins")), "dst")
    edges = durable(edges.select("src", "dst", (F.col("links") / F.col("outs")).alias("forth"), (F.col("links") / F.col("ins")).alias("back")))
    hosts = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).unionByName(shares.select("host"))
    base = durable(hosts.distinct().join(start, "host", "left").na.fill(0.0))
    now = base
    # all changes together shrink by the damping in each round, so this ends
    for i in itertools.count() if rounds is None else range(rounds):
        before = now
        forth = edges.join(now.where("trust > 0").select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (F.col("trust") * F.col("forth") * damping).alias("t"), F.lit(0.0).alias("d"))
        back = edges.join(now.where("distrust > 0").select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back") * damping).alias("d"))
        seeds = base.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        now = seeds.unionByName(forth).unionByName(back).groupBy("host").agg(F.sum("t").alias("trust"), F.sum("d").alias("distrust"))
        if i % 3 == 2:
            now = durable(now)
        if rounds is None and i % EVERY == EVERY - 1:
            old = before.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
            moved = F.greatest(F.abs(F.col("trust") - F.col("t")), F.abs(F.col("distrust") - F.col("d")))
            if (now.join(old, "host").agg(F.max(moved)).first()[0] or 0.0) <= TOLERANCE:
                break
    return now


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    placed = placed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    n = F.count(F.lit(1))
    shares = placed.where("host <> ''").groupBy("host").agg((F.count_if(F.col("ruled") == "allow") / n).alias("allowed"), (F.count_if(F.col("ruled") == "block") / n).alias("blocked"))
    scores = durable(propagate(shares, host_links(pages), rounds, damping))
    net = F.coalesce(F.round((F.col("distrust") - F.col("trust")) / (1 - damping), 9), F.lit(0.0))
    judged = join_small(placed, scores, ["host"], salt=F.xxhash64("page_id", "path"))
    method = F.when(net > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The same, one common table for each round."""
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{f(h, p, v)}'" for h, p, v in ordered) + " END"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = low.format("coalesce(regexp_extract({}, '" + URL + "', 1), '')")
    rounds = "".join(
        f""",
n{i + 1} AS (SELECT host, sum(t) AS trust, sum(d) AS distrust FROM (
  SELECT host, trust AS t, distrust AS d FROM n0
  UNION ALL SELECT e.dst, n.trust * e.forth * {DAMPING}, 0 FROM edges e JOIN n{i} n ON n.host = e.src
  UNION ALL SELECT e.src, 0, n.distrust * e.back * {DAMPING} FROM edges e JOIN n{i} n ON n.host = e.dst) GROUP BY host)"""
        for i in range(ROUNDS)
    )
    return f"""
WITH placed AS (SELECT page_id, html, {host.format('url')} AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
ruled AS (SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS ruled FROM placed),
hrefs AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{HREF.replace("'", "''")}', 1)) AS href FROM placed),
pairs AS (SELECT src, {host.format("CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END")} AS dst FROM hrefs WHERE contains(href, '//')),
links AS (SELECT src, dst, count(*)::DOUBLE AS links FROM pairs WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
edges AS (SELECT src, dst, links / sum(links) OVER (PARTITION BY src) AS forth, links / sum(links) OVER (PARTITION BY dst) AS back FROM links),
shares AS (SELECT host, count(*) FILTER (ruled = 'allow') / count(*)::DOUBLE AS allowed, count(*) FILTER (ruled = 'block') / count(*)::DOUBLE AS blocked FROM ruled WHERE host <> '' GROUP BY host),
hosts AS (SELECT src AS host FROM links UNION SELECT dst FROM links UNION SELECT host FROM shares),
n0 AS (SELECT h.host, coalesce(allowed, 0) * (1 - {DAMPING}) AS trust, coalesce(blocked, 0) * (1 - {DAMPING}) AS distrust FROM hosts h LEFT JOIN shares s ON s.host = h.host){rounds}
SELECT page_id, r.host, path, rule,
  coalesce(ruled, CASE WHEN coalesce(round((distrust - trust) / (1 - {DAMPING}), 9), 0) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN n{ROUNDS} n ON n.host = r.host
"""


SQL = _sql()
