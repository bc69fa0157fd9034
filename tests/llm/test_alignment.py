"""Tokenizer alignment against a plain loop over the two libraries' own tokens."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import Row

from taleweave.llm import alignment

TEXTS = {
    1: "the same words again and again, the same words", 2: "the same words again and again, the same words", 3: "", 4: None, 5: " ", 6: "  two  spaces\n\n and\ttabs ", 7: "<|endoftext|> and <s> are text",
    8: "naïve 東京 \U0001f600 text", 9: "a▁b", 10: "nul\x00 byte", 11: "x" * 3000, 12: "don't can't it's 12345 67.8%", 13: "tail ", 14: " odd  spaces \x1c here", 15: "the", 16: "a\r\nb \r\n c", 17: "東京" * 400,
}


def plain(rows):
    """[(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)] by one loop over byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    letters, names = alignment.byte_alphabet(), {i: t for t, i in a.get_vocab().items()}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def spans(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    made, counts = [], Counter()
    for i, t in rows:
        x, y, parts = [], [], ([], [])
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            parts = [bytes(letters[c] for c in names[k]) for k in x], [piece(k) for k in y]
            if any(b"".join(p) != (" " + t).encode() for p in parts):
                x, y, parts = [], [], ([], [])
        xs, ys = spans(parts[0]), spans(parts[1])
        links, j = [], 0
        for k, (s, e) in zip(x, xs, strict=True):
            while j and ys[j - 1][1] > s:
                j -= 1
            while j < len(ys) and ys[j][0] < e:
                if ys[j][1] > s:
                    links.append((k, y[j]))
                j += 1
        ends = sorted({e for _, e in xs} & {e for _, e in ys})
        groups, last = [], 0
        for end in ends:
            own = [",".join(str(k) for k, (_, e) in zip(ids, sp, strict=True) if last < e <= end) for ids, sp in ((x, xs), (y, ys))]
            groups.append("|".join(own))
            last = end
        counts.update(links)
        made.append((i, len(x), len(y), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted((i, x, y, g, len(li), sum(counts[p] == best[p[1]] for p in li), sum(counts[p] for p in li), sha) for i, x, y, g, li, sha in made)


def tuples(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_equals_the_plain_loop_on_odd_texts(spark):
    rows = [(i, t) for i, t in TEXTS.items()] + [(1, TEXTS[1])]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, links="own", sums=1) for i, t in rows], "doc_id long, text string, links string, sums int").repartition(3)
    assert tuples(alignment.linked(docs)) == plain(rows)


@pytest.mark.parametrize("most", [alignment.BROADCAST_PAIRS, 3])
def test_equals_the_plain_loop_on_the_smallest_table(spark, most):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    if most < 10:
        docs = docs.limit(40)
    assert tuples(alignment.linked(docs, most=most)) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_groups_and_links_of_a_text(spark):
    rows = alignment.aligned(alignment.tokens(spark.createDataFrame([("k", "naïve text")], "doc_id string, text string")))
    found = rows.withColumn("links", alignment.at_links(("link", alignment.link))).first()
    assert len(found.links) == len(found.a_ids) + len(found.b_ids) - len(found.groups)
    assert found.doc_id == "k" and ",".join(g.split("|")[0] for g in found.groups) == ",".join(map(str, found.a_ids)) and ",".join(g.split("|")[1] for g in found.groups) == ",".join(map(str, found.b_ids))
    assert {(x.link >> 32, x.link & 0xFFFFFFFF) for x in found.links} <= {(a, b) for a in found.a_ids for b in found.b_ids}


def test_shelves_of_any_size_give_equal_rows(spark, monkeypatch):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").coalesce(1)
    whole = tuples(alignment.linked(docs))
    monkeypatch.setattr(alignment, "SHELF", 1)
    assert tuples(alignment.linked(docs)) == whole


def test_empty_table(spark):
    assert alignment.linked(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_links_are_summed_where_they_lie(spark):
    """The links of a shelf, its widest column, don't go through a shuffle before they are summed."""
    rows = spark.createDataFrame([(0, [(5, 0, 1), (6, 0, 1), (5, 1, 2)]), (1, [(6, 0, 1)])], "_row long, links array<struct<link: long, chunk: int, times: int>>")
    counts = spark.createDataFrame([(5, 3, True), (6, 2, False)], "link long, count long, best boolean")
    found = alignment.weights(rows, counts)
    assert "RepartitionByExpression" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["_row"]: [tuple(x) for x in r["sums"]] for r in found.collect()} == {0: [(0, 1, 5), (1, 1, 3)], 1: [(0, 0, 2)]}


@pytest.mark.parametrize("most", [alignment.BROADCAST_PAIRS, 3])
def test_frequent_chunks_are_aligned_once(spark, monkeypatch, most):
    """Chunks known from a sample are no part of what a shelf aligns, and all rows stay as the plain loop has them."""
    monkeypatch.setattr(alignment, "SAMPLE", 1)
    rows = [(i * 100 + k, t) for k in range(3) for i, t in TEXTS.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    heads = spark.sparkContext.broadcast(alignment.heads_of(docs, alignment.A_FILE, alignment.B_FILE))
    assert {"again", "東京", "12345"} <= set(heads.value.chunks)
    shelves = alignment.shelves(docs, heads).collect()
    assert sum(len(r["times"]) for r in shelves) <= 10 < sum(len(r["heads"]) for r in shelves)
    assert tuples(alignment.linked(docs, most=most)) == plain(rows)
