"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from taleweave.llm import exact, fingerprints, language, mixing, neardup, quality, sentencepieces, toxicity, urls, webpages
from taleweave.llm.common import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, component_id int, score string, held_out int"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = ["a b c d e f g", "a b c d e f g", "a  b c\td e f g", None, "", "  \n ", "x", LONG, "one two three four five six", "one two three four five SIX", "123 456", "é" * 50]


def docs(spark, texts=TEXTS, **columns):
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 3 else f"s{i % 2}", None, 1, "k", 2, "s", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def repeated(spark):
    return docs(spark).unionByName(docs(spark).limit(3)).unionByName(docs(spark).limit(1).withColumn("doc_id", F.lit(None).cast("long")))


def labels(spark, name="toxic"):
    return spark.createDataFrame([(i, i % 2) for i in range(12)] + [(0, None), (None, 1)], f"doc_id long, {name} int")


def run(op, spark, frame):
    if op == "op1":
        return mixing.mix(frame)
    if op == "op2":
        return neardup.link(frame, 3, 85)
    if op == "op3":
        return exact.dedup(frame)
    if op == "op4":
        return language.classify(frame, language.fit(frame, fold("doc_id", 3) != 1, 5), fold("doc_id", 3) == 1)
    if op == "op5":
        return toxicity.score(frame, toxicity.fit(frame, labels(spark), fold("doc_id", 4) != 2), fold("doc_id", 4) == 2)
    if op == "op6":
        return sentencepieces.round_trips(frame)
    if op == "op7":
        return quality.score(frame, quality.fit(frame, labels(spark, "quality"), fold("doc_id", 3) != 1), fold("doc_id", 3) == 1)
    return fingerprints.with_edits(frame)


@pytest.mark.parametrize("op", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op10"])
def test_odd_rows(op, spark):
    assert run(op, spark, docs(spark)).count() == len(TEXTS)
    assert run(op, spark, docs(spark, [])).count() == 0
    n = run(op, spark, repeated(spark)).count()
    assert n == len(TEXTS) + 4
    assert run(op, spark, docs(spark, [None, None])).count() == 2


def test_mixing_targets(spark):
    texts = [" ".join(["w"] * (5 + i % 40)) for i in range(400)]
    frame = spark.createDataFrame([(i, t, None if i % 5 == 4 else f"s{min(i % 5, 2)}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    m = mixing.mix(frame)
    got = {r["source"]: r for r in m.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sum("size").alias("size")).collect()}
    assert all(abs(r["taken"] - r["target"]) <= 25 and r["target"] <= 3 * r["size"] + 1e-9 for r in got.values())
    assert abs(sum(r["target"] for r in got.values()) - sum(r["size"] for r in got.values())) < 1e-6
    assert m.where("taken > 3 * size").isEmpty()
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, mixing.mix(frame.repartition(7)).collect()))
    mixture = mixing.Mixture(frame)
    want = {r["doc_id"]: r["copies"] for r in mixture.table().collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixture.expand(frame).groupBy("doc_id").count().collect()} == want
    weighed = mixing.mix(frame.withColumn("own", F.col("doc_id") % 3), weight="own")
    assert weighed.where("doc_id % 3 = 0 AND copies > 0").isEmpty() and weighed.where("copies > 3").isEmpty()


def test_near_duplicates_against_brute_force(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(2, 120))
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    sets = [frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)]) for w in (t.split() for t in texts)]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if 100 * len(a & b) >= 85 * len(a | b):
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    got = {r["doc_id"]: r["component_id"] for r in neardup.link(docs(spark, texts), 3, 85).collect()}
    assert got == dict(enumerate(up))
    assert {r["doc_id"] for r in neardup.keep_one(docs(spark, texts), 3, 85).collect()} == set(up)


def test_near_duplicates_of_odd_texts(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.link(docs(spark), 3, 85).collect()}
    assert got[0] == (5, 0, True) and got[1] == (5, 0, False) and got[2] == (5, 0, False)
    assert got[3] == got[3][:1] + (3, True) and got[3][0] == got[4][0] == got[5][0] == 0
    assert got[6] == (1, 6, True) and got[9][1] == 8  # only case differs


def test_perfect_hash():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (5000, 2), dtype=np.uint64)
    mph = exact.PerfectHash.build(keys[:, 0], keys[:, 1])
    assert sorted(mph.slots(keys[:, 0], keys[:, 1])) == list(range(5000))
    others = rng.integers(0, 2**63, (1000, 2), dtype=np.uint64)
    assert mph.slots(others[:, 0], others[:, 1]).max() < 5000


def test_exact_history(spark):
    old = exact.build_index(exact.digests(docs(spark, ["a b", "c"])))
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact.dedup(docs(spark, ["ab", "new", "n e w", "c"]), old).collect()}
    assert got == {0: (0, False), 1: (2, False), 2: (2, True), 3: (1, False)}
    assert sorted(r["doc_id"] for r in exact.keep_first(docs(spark)).collect()) == [2, 5, 6, 7, 8, 9, 10, 11]
    assert exact.keep_first(docs(spark).unionByName(docs(spark))).count() == 8


def test_language(spark):
    import random

    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("aeiou" if i % 2 else "xyzwv") for _ in range(5)) for _ in range(30)) for i in range(120)]
    frame = spark.createDataFrame([(i, t, ["aa", "bb"][i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = language.classify(frame, language.fit(frame, fold("doc_id", 3) != 1), fold("doc_id", 3) == 1).join(frame, "doc_id")
    assert got.where("held_out AND lang_pred <> lang").isEmpty()
    odd = language.classify(docs(spark), language.fit(frame, F.lit(True)), F.lit(True))
    assert {r["doc_id"]: r["lang_pred"] for r in odd.collect() if r["lang_pred"] == "und"}.keys() == {3, 4, 5, 10}


def test_lexicon():
    lex = toxicity.Lexicon(["idiot", "scum", "worthless"], ["lowei"], ["idio"])
    assert lex.match("idiot") == ("idiot", 1.0) and lex.match("loweithing") == ("lowei", 1.0)
    for typo in ("idit", "idiott", "iddiot", "1diot", "idoit", "worthles", "wrothless"):
        assert lex.match(typo), typo
    for clean in ("idio", "scam", "scumm", "world", "riot", "low", "worth", "patriot"):
        assert lex.match(clean) is None, clean


def test_misspelt_stems():
    lex = toxicity.Lexicon(["scum"], ["achlich", "réeux", "lowe"], ["bchlichen"])
    for typo in ("achlihen", "acchlichen", "ahclichen", "achilchen", "axhlichkeit", "achlixhes", "chlichen", "réuxment", "rééuxes", "rézuxant", "érexuse", "réexuse"):
        m = lex.match(typo)
        assert (m is None) if typo == "érexuse" else (m and m[0] in ("achlich", "réeux") and m[1] == toxicity.FUZZY), typo
    assert lex.match("achlichkeit") == ("achlich", 1.0)
    for clean in ("bchlichen", "ahclihcen", "lwoer", "loewing", "world", "achtung", "reu"):
        assert lex.match(clean) is None, clean


def test_quotation_weighs_less():
    hits = {"scum": ("scum", 1.0)}
    said, quoted = toxicity.document_features("you are scum here", hits), toxicity.document_features('it said "you are scum" here', hits)
    assert quoted[1] < said[1] and toxicity.document_features("clean", hits) == [0.0, 0.0, 0.0]


def test_long_quotations():
    hits = {"scum": ("scum", 1.0)}
    weight = lambda text: toxicity.document_features(text, hits)[1]
    long = "word " * 200
    for a, b in ('""', "“”", "„“", "«»", "‘’"):
        assert weight(f"it said {a}{long}scum{b} here") == weight(f"it said {a}one\ntwo scum{b} here") == toxicity.QUOTED
        assert weight(f"{a}{long}{b} scum {a}x{b}") == 1.0
        assert weight(f"a stray {a} here\n\nscum {b} there") == 1.0
    assert toxicity.quotations("“one ‘two’ three” four \"\"five\"\"") == [(0, 17), (24, 30)]
    assert weight("a " + '"' * 50_000 + " scum") == 1.0


def test_quality_lines():
    import numpy as np

    x, counts, sizes = quality.line_features(["a\nb c\n\nGOOD!!", None, ""])
    assert list(counts) == [4, 1, 1] and len(x) == 6 and list(sizes) == [1, 3, 0, 6, 0, 0] and np.isfinite(x).all()
    emit, move = np.log(np.array([[0.9, 0.1], [0.4, 0.6], [0.2, 0.8]])), np.log(np.array([[0.7, 0.3], [0.4, 0.6]]))
    total, per_line = 0.0, np.zeros(3)
    for path in np.ndindex(2, 2, 2):
        p = np.exp(sum(emit[i, s] for i, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        total, per_line = total + p, per_line + p * np.array(path)
    got, _ = quality.marginals(emit, np.array([3]), move)
    assert np.allclose(got, per_line / total)


def test_tokenizer_parity():
    buf = open(sentencepieces.MODEL, "rb").read()
    texts = ["", " ", "a  b", "  Hello  world\n\tfoo ñ 漢字 😀 ", "<s> </s> <unk> <0x0A>", "▁▁x", "\0a"] + [" " * n + "w" + " " * n for n in range(40)] + [t or "" for t in TEXTS]
    assert sentencepieces.parity(texts, buf) == []


def test_encode_and_decode(spark):
    back = sentencepieces.decode(sentencepieces.encode(docs(spark).select("doc_id", "text", F.lit(1).alias("ids"))))
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())


def test_urls(spark):
    rows = [("HTTP://A.Example.COM/en/71?x", None), ("https://example.com/en/8#a", ""), ("http://com/en/", "<a href='http://b.net/'>"), (None, None), ("no host", None), ("x://notexample.com/en/7", None), ("http://b.net/fr", None), ("http://b.net/de/8", None), ("http://example.net/de/81", None)]
    pages = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2] == ("com", "/en/", "com/en/", "block")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("com/en/", "block")
    assert got[7][2:] == ("net/de/", "allow") and got[8][2:] == ("example.net/de/8", "block")
    assert urls.judge(pages.where("false")).count() == 0


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [("http://good.net/de/1", link("fine.org")), ("http://fine.org/a", ""), ("http://farm.org/a", link("bad.com", "bad.com")), ("http://bad.com/en/1", None)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["host"]: (r["trust"], r["distrust"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got["fine.org"][0] > 0 and got["fine.org"][2] == "allow" and got["farm.org"][1] > 0 and got["farm.org"][2] == "block"


def test_distrust_in_a_cycle(spark):
    """Two hosts that link to each other; 3 of 20 pages of one are blocked: its share of distrust is 0.15 / (1 - 0.85^2)."""
    links = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, links long")
    shares = spark.createDataFrame([("a", 0.0, 0.15), ("b", 0.0, 0.0)], "host string, allowed double, blocked double")
    got = {r["host"]: r["distrust"] for r in urls.propagate(shares, links).collect()}
    assert abs(got["a"] / 0.15 - 0.15 / (1 - 0.85**2)) < 1e-4 and got["a"] / 0.15 > urls.THRESHOLD


def test_main_text():
    page = '<html><head><title>T</title></head><body><nav><a>m</a></nav><article><h1>A&amp;B</h1><p>one <b>t</b>wo<br>three<p>four<div class="share-bar">no</div><script>var a="<p>x</p>";</script><form>f</form><aside>s</aside></article><footer>f</footer>'
    assert webpages.main_text(page) == "A&B one two three four"
    assert webpages.main_text(None) == webpages.main_text("") == "" and webpages.main_text("plain <b>t</b>ext") == "plain text"
    assert webpages.main_text("<p>a &lt; b < c</p><!-- no -->") == "a < b < c"


def test_template_text_goes(spark):
    body = lambda i: f"<body><div>Our shop</div><div><p>Story {i} is told</p><p>All rights kept</p></div></body>"
    rows = [(i, f"http://h.x/{i}", body(i)) for i in range(8)] + [(8, "http://other.x/", body(8)), (9, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in webpages.extract(pages).collect()}
    assert got[3][0] == "Story 3 is told"
    assert got[8][0].startswith("Our shop") and got[9] == ("", 0)
    assert webpages.extract(pages.where("false")).count() == 0


def test_template_text_in_articles(spark):
    body = lambda i: f"<body><main><h1>Title {i}</h1><div><p>Story {i} is told</p></div><div class=x>Written by our staff</div></main></body>"
    rows = [(i, f"http://h.x/{i}", body(i)) for i in range(8)]
    rows += [(i, f"http://same.x/{i}", f"<body><nav>{i}</nav><article><h1>One</h1><p>Often told</p></article></body>") for i in range(8, 16)]
    got = {r["page_id"]: r["text"] for r in webpages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3 Story 3 is told" and got[9] == "One Often told"


def test_fingerprints_against_brute_force(spark):
    import xxhash

    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    h64 = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed)

    def chain(values):
        seed = 42
        for v in values:
            seed = h64((v % 2**64).to_bytes(8, "little"), seed)
        return signed(seed)

    def fingerprint(text):
        w = [signed(h64(x.encode())) for x in low(text)]
        if not w:
            return ""
        hashes = {chain(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        bins = {}
        for h in hashes:
            b = (h >> (64 - fingerprints.BITS)) + fingerprints.BINS // 2
            bins[b] = min(bins.get(b, 2**63), h)
        return "".join(f"{bins[b] & 15:x}" if b in bins else f"{bins[min(bins, key=lambda j: pick(b, j))] & 15:x}" for b in range(fingerprints.BINS))

    def pick(b, j):
        seed = h64(int(b).to_bytes(4, "little"), 42)
        return (signed(h64(int(j).to_bytes(4, "little"), seed)) & -fingerprints.BINS) | j

    frame = docs(spark)
    got = {r["doc_id"]: r for r in fingerprints.with_edits(frame).collect()}
    n = len(TEXTS)
    for i, t in enumerate(TEXTS):
        t, nxt = t or "", TEXTS[(i - 1) % n] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == fingerprint(t), i
        assert got[i]["edited_fingerprint"] == fingerprint(edited)
        assert 0 <= got[i]["near_edited"] <= 1
    assert got[2]["near_next"] == 1.0 and got[4]["near_next"] == 1.0 and got[5]["near_next"] == 1.0 and got[7]["near_next"] < 0.2


def test_fingerprints_have_256_bins(spark):
    got = [r[0] for r in fingerprints.fingerprint(docs(spark).where("length(trim(text)) > 5")).select("fingerprint").collect()]
    assert fingerprints.BINS == 256 and got and {len(x) for x in got} == {256}


def test_next_rows_over_many_runs(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 100_003).alias("k"), F.col("id").cast("string").alias("t")).repartition(5)
    got = {r["k"]: r["next_k"] for r in fingerprints.with_next(frame, "k", "t", ["k"]).collect()}
    keys = sorted(got, reverse=True)
    assert len(keys) == 1000 and all(got[a] == b for a, b in zip(keys, keys[1:] + keys[:1]))
