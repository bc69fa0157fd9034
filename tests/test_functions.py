"""Functions on hand-made rows."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taleweave.functions import relevance as R
from taleweave.functions import text as X
from taleweave.functions.random import Mulberry32
from taleweave.sources.chat import sample_chunks


def values(spark, column, rows, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


def test_names(spark):
    assert values(spark, X.norm_name("s"), ["  ann  ", "Ann  of   X", None]) == ["ann", "ann of x", ""]
    assert values(spark, X.slug("s"), ["Ann of X!", "--a--", ""]) == ["chr-ann-of-x", "chr-a", "chr-"]
    assert values(spark, X.chat_scoped_id("s", F.lit(None).cast("string")), ["Ann"]) == ["chr-ann"]
    assert values(spark, X.chat_scoped_id("s", F.lit("c")), ["Ann"]) == ["chr-84a516-ann"]


def test_state_keys(spark):
    keys = ["Gate's Status", "gate status", "GATE-STATE", "north_pursuit", "pursuit", "ship_log", "worship", None]
    assert values(spark, X.state_key("s"), keys) == ["gates", "gate", "gate", "north_pursuit", "pursuit", "ship_log", "worship", ""]
    assert values(spark, X.is_snapshot_key("s"), keys) == [False, False, False, True, True, True, False, False]


def test_chunks(spark):
    for n, want in ((0, 1), (1, 1), (2000, 1), (2001, 2), (3600, 2), (3601, 3), (5200, 3)):
        text = "".join(chr(97 + i % 26) for i in range(n))
        (got,) = values(spark, X.chunks("s"), [text])
        assert len(got) == want
        assert got[0] == text[:2000] and text.endswith(got[-1])
        assert all(a[1600:] == b[: len(a) - 1600] for a, b in zip(got, got[1:]))


def test_quotes(spark):
    rows = ['say "hello there" and “good day”', '"no\nline"', '"abc"', '"' + "x" * 400 + '"', '"' + "x" * 401 + '"', None]
    assert values(spark, X.quotes("s"), rows) == [["hello there", "good day"], [], [], ["x" * 400], [], []]


def test_strip_blocks(spark):
    assert values(spark, X.strip_blocks("s"), ["a <think>x\ny</THINK> b", "a <info_board> open", "plain  text"]) == ["a b", "a", "plain text"]


def test_disposition(spark):
    f = X.disposition(F.col("s"), F.lit("personality"), ["stoic"], ["angry", "weary", "awed"], {"angry": 0.8, "weary": 0.3})
    assert values(spark, f, ["stoic", "was angry", "weary", "awed", "unknownword", "the", None]) == ["accept", "reject", "verify", "reject", "verify", "verify", "verify"]


def test_transient(spark):
    f = X.is_transient(F.col("s"), ["annoy", "calm"])
    assert values(spark, f, ["annoyed", "annoyed at staff", "calm", "annoyed one two three four five", "", None]) == [True, True, True, False, False, False]


def test_query_terms(spark):
    assert values(spark, X.query_terms("s"), ["Where is the RED gate, the red one?", "is it", None]) == [["red", "gate"], [], []]


def test_trigrams(spark):
    assert values(spark, F.round(R.trigram_similarity("s", F.lit("word")), 4), ["word", "words", "", "xyz"]) == [1.0, 0.5714, 0.0, 0.0]
    both = spark.createDataFrame([("two words", "words two")], "a string, b string").select(R.trigram_similarity("a", "b"), R.trigram_similarity("b", "a")).first()
    assert both[0] == both[1] == 1.0


def test_rank(spark):
    got = values(spark, F.round(R.or_rank("s", ["cat"]), 7), ["a cat", "cat cat", "dog", None])
    assert got == [0.0607927, 0.0759909, 0.0, 0.0]


def test_loose_json(spark):
    raw = ['{"k": 1,}', 'Text\n```json\n{"k": 1}\n```', 'so {"k": 1} it is']
    got = values(spark, F.array_max(F.transform(X.json_candidates("s"), lambda x: F.get_json_object(x, "$.k"))), raw)
    assert got == ["1", "1", "1"]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_random_range(seed):
    draw = Mulberry32(seed)
    assert all(0 <= draw() < 1 for _ in range(20))


def test_sample_chunks():
    text = "".join(chr(97 + i % 26) for i in range(20_000))
    got = sample_chunks(text, 5)
    assert got == sample_chunks(text, 5) and len(got) == 5
    assert all(b - a >= 1000 for (a, _), (b, _) in zip(got, got[1:])) and all(text[a : a + 1000] == c for a, c in got)
