"""Templates of hosts: against explicit occurrence vectors, without names, and on broken, odd and repeated pages."""

import time
from collections import Counter

from pyspark.sql import functions as F

from taleweave.llm import webpages as w

KIND = "page_id long, url string, html string"


def shop(i, extra=""):
    """No article, no known names: only the pages of the host tell what belongs to its layout."""
    links = "".join(f'<li><a href="/{k}">part {k}</a></li>' for k in range(4))
    return f'<body><div class="zq{i}"><ul>{links}</ul></div><div class="xx">Buy {"more " * (i % 3)}now</div><div class="yy"><h1>Title {i}</h1><p>{"Story of number %d is long. " % i * 4}</p><div class="by">Our desk wrote this</div>{extra}</div><div class="zz">&copy; us</div></body>'


def story(i):
    return f"Title {i} " + " ".join(["Story of number %d is long." % i] * 4)


def texts(spark, rows, **options):
    return {r["page_id"]: r["text"] for r in w.extract(spark.createDataFrame(rows, KIND), **options).collect()}


def test_template_alone_decides(spark):
    rows = [(i, f"http://shop.x/{i}", shop(i)) for i in range(9)]
    got = texts(spark, rows, names=False)
    assert got == {i: story(i) for i in range(9)}
    assert got == texts(spark, rows) == texts(spark, rows, broadcast_texts=-1) == texts(spark, rows[::-1] + rows[:1])
    alone = texts(spark, rows, least=100)
    assert all("Our desk" in t and "part 0" in t and "us" in t for t in alone.values())


def test_few_pages_share_a_layout(spark):
    rows = [(i, f"http://h{i}.x/", shop(i)) for i in range(9)]
    assert texts(spark, rows, names=False) == {i: story(i).replace(" Story", " Story", 1) + " Our desk wrote this" for i in range(9)}


def test_against_explicit_vectors(spark):
    extras = ["", "<table><tr><td>Rare note</td></tr></table>", "<p>twice</p><p>twice</p>"]
    sources = [(f"http://{'a' if i % 4 else 'b'}.x/{i}", shop(i, extras[i % 3])) for i in range(40)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(sources)], KIND)
    host = F.xxhash64(F.regexp_extract("url", "://([^/]*)", 1))
    frame = pages.select(host.alias("host"), F.lit(0).cast("long").alias("layout"), F.xxhash64("html").alias("page"), "html")
    got = {(r["group"], r["token"]) for r in w._template_texts(w._tokens(frame, w.LEAST_PAGES)).collect()}
    want = set()
    for group, of in [(r["host"], r["urls"]) for r in pages.groupBy(host.alias("host")).agg(F.collect_list("html").alias("urls")).collect()]:
        parsed = [w.Page(h) for h in of]
        paths = {r: p for page in parsed for r, p in page.paths.items()}
        roles = {r: tuple(page.roles.get(r, 0) for page in parsed) for r in paths}
        counts = [Counter(b.token() for b in page.blocks) for page in parsed]
        for token, role in {(b.token(), b.role) for page in parsed for b in page.blocks}:
            vector = tuple(c[token] for c in counts)
            if sum(n > 0 for n in vector) >= w.LEAST_PAGES and any(roles[r] == vector for r in paths[role]):
                want.add((group, token))
    assert got == want and len(want) >= 8


def test_articles_published_often(spark):
    rows = [(i, f"http://same.x/{i}", f"<body><nav>{i}</nav><article><h1>One</h1><p>Often told</p></article></body>") for i in range(8)]
    assert set(texts(spark, rows).values()) == {"One Often told"}


def test_odd_pages(spark):
    wide = spark.createDataFrame([(None, None, None), (1, "", ""), (1, "http://x/", "<p>a"), (1, "http://x/", "<p>a")], KIND).withColumn("host", F.lit("clash")).withColumn("texts", F.lit(1)).withColumn("page", F.lit(2))
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in w.extract(wide).collect())
    assert got == [(0, "", 0), (1, "", 0), (1, "a", 1), (1, "a", 1)]
    assert w.extract(wide.where("false")).count() == 0


def test_time_in_proportion():
    began = time.time()
    for bad in ('<a "' * 1_200_000, "<div>" * 400_000, "<!" * 1_000_000, "<a '\">" * 300_000, "\"'<a " * 300_000, "<b>x<br>" * 100_000, "<p " + "id " * 500_000, "<script>" * 200_000):
        w.main_text(bad)
    assert time.time() - began < 30
    assert w.main_text("word " * 1_000_000) == "word " * 999_999 + "word"


def test_attributes():
    assert w.main_text('<p><a href="/x?id=menu">kept</a></p>') == "kept"
    assert w.main_text("<p class=menu>gone</p><p hidden>gone</p><p data-x='hidden'>kept</p>") == "kept"
    assert w.main_text("<div><script>var a='<p>no</p>'</script><p>yes<button>no</button></div>") == "yes"
    assert w.main_text('<p title="a > b">one</p><p title="it\'s">two</p>') == "one two"
