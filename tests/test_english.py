"""The English analyzer: stems of the public vocabulary, stop words, places, headlines and the index."""

import random
import re

import pytest

from taleweave.functions import english
from taleweave.operators import postings

# Pairs of the published sample vocabulary, and hand-checked words for each step.
PAIRS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol
consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir
conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel
kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knife knife knight knight knightly knight knights knight knit knit knits knit
knitted knit knitting knit knives knive knob knob knocked knock knocker knocker knockers knocker knocking knock knots knot
orders order ordered order relational relat conditional condit hopefulness hope happy happi flying fli cries cri ties tie cry cri by by say say hopping hop hoping hope
luxuriated luxuri gas gas kiwis kiwi gaps gap skies sky dying die news news inning inning proceed proceed succeeded succeed generate generat general general
generous generous communism communism arsenal arsenal apology apolog fully fulli analogi analog youthful youth beauty beauti skating skate agreed agre feed feed
plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size falling fall hissing hiss failing fail filing file
triplicate triplic formalize formal electrical electr goodness good adjustment adjust adoption adopt controlling control roll roll rate rate cease ceas
""".split()  # fmt: skip


@pytest.mark.parametrize(("word", "stem"), list(zip(PAIRS[::2], PAIRS[1::2], strict=True)))
def test_stems(word, stem):
    assert english.stem(word) == stem


def test_the_checking_sql_finds_the_same_stems():
    import duckdb

    rng = random.Random(5)
    parts = "a e i o u y ing ed s es ies ied eed ly li ation ization ful ness ment ement al ical ive ize ate b c d l m n r s t st gener y ing sses us ll tt ogi ent".split()
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(6000)} | set(PAIRS) | set(english.WHOLE) | set(english.KEPT_AFTER_PLURAL))
    con = duckdb.connect()
    con.execute("CREATE TABLE words AS SELECT unnest(?) AS word", [words])
    theirs = dict(con.execute(f"WITH {english.stems_sql('words')} SELECT word, stem FROM stems").fetchall())
    assert {w: (english.stem(w), theirs[w]) for w in words if english.stem(w) != theirs[w]} == {}


def test_lexemes_and_places():
    assert english.lexemes("The orders, and an Order of 12 the ships' crew!") == (["order", "order", "12", "ship", "crew"], [2, 5, 7, 9, 10])
    assert english.lexemes(None) == ([], []) and english.lexemes("the of") == ([], [])
    assert english.query_lexemes(["orders", "the", "order", "ships"]) == ["order", "ship"]


def test_columns(spark):
    df = spark.createDataFrame([(1, "Orders order ships"), (2, None), (3, "the"), (4, "no match here")], "id int, t string")
    got = {r.id: r for r in df.select("id", english.analysed("t").alias("a"), english.times_of("t", ["order", "ship"]).alias("n"), postings.vector_text(postings.postings("t")).alias("v")).collect()}
    assert got[1].a.terms == ["order", "order", "ship"] and got[1].a["at"] == [1, 2, 3] and got[1].n == [2, 1] and got[1].v == "'order':1,2 'ship':3"
    assert got[2].a.terms == [] and got[2].n == [0, 0] and got[2].v == "" and got[3].v == ""


def test_index_gives_the_rows_of_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    words = ["order", "orders", "ordering", "ship", "ships", "sea", "the", "storm", "stormy"]
    rows = [(i, f"c{i % 3}", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(80, "c0", 80, None)]
    df = spark.createDataFrame(rows, "id int, chat_id string, message_index int, t string")
    terms = english.query_lexemes(["orders", "storms"])
    index = postings.write(postings.build(df, "t", ["id", "chat_id", "message_index"]), f"{tmp_path}/index", parts=3)
    by_index = [(r.id, r.rank) for r in postings.ranked(index.where("chat_id <> 'c2'"), terms, 20).collect()]
    scan = df.where("chat_id <> 'c2'").select("id", F.round(postings.or_rank(english.times_of("t", terms)), 9).alias("rank")).where("rank > 0").orderBy(F.desc("rank"), "id").limit(20)
    assert by_index == [(r.id, r.rank) for r in scan.collect()] and len(by_index) == 20
    found = {r.id for r in postings.phrase(index, ["ship", "sea"], ("id",)).collect()}
    assert found == {i for i, _, _, t in rows if t and re.search(r"\bships? sea\b", t)}
    assert postings.ranked(index, [], 5).collect() == []


def brute_fragments(text, terms):
    """Matches in order; each that no fragment holds opens one, grown a word at a time from a list of free words."""
    words = re.findall("[A-Za-z0-9]+", text)
    hit = [w.lower() not in english.STOP_WORDS and english.stem(w.lower()) in terms for w in words]
    out = []
    for i, h in enumerate(hit):
        if not h or len(out) == 5 or any(a <= i <= b for a, b in out):
            continue
        walls = sorted([-1, len(words), *(x for a, b in out for x in (a, b))])
        left = max(w for w in walls if w < i) + 1
        right = min(w for w in walls if w > i) - 1
        a = max(left, i - 74)
        a = next(k for k in range(a, i + 1) if k == i or len(words[k]) > 3 or hit[k])
        b = min(right, a + 149)
        b = next(k for k in range(b, i - 1, -1) if k == i or len(words[k]) > 3 or hit[k])
        out.append((a, b))
    return sorted(out)


def test_headline_fragments_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        text = " ".join(rng.choice(["storm", "a", "to", "word", "longer", "of", "x"]) if rng.random() < 0.05 else rng.choice(["word", "longer", "of", "the", "sea"]) for _ in range(rng.randint(0, 1500)))
        terms = frozenset(["storm"])
        assert english.fragments(text, terms) == brute_fragments(text, terms)
        for (_, b), (a, _) in zip(english.fragments(text, terms), english.fragments(text, terms)[1:], strict=False):
            assert b < a


def test_headline_text():
    assert english.marked("The Storms, and calm.", frozenset(["storm"])) == "<b>Storms</b>, and calm"
    assert english.marked("one two three", frozenset(["storm"])) == "one two three" and english.marked(None, frozenset()) == ""
    long = " ".join(["word"] * 200 + ["storm"] + ["word"] * 400 + ["stormy", "storms"])
    parts = english.marked(long, frozenset(["storm"])).split(" ... ")
    assert len(parts) == 2 and all(len(p.split()) <= 150 for p in parts) and "<b>storm</b>" in parts[0] and "<b>storms</b>" in parts[1]
