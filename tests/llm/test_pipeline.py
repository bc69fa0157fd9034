"""The pipeline on the smallest documents: each stage's columns and what it keeps."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    import corpus_pipeline as p
    from taleweave.llm import exact, neardup
    from taleweave.llm.common import durable, table

    docs = table(spark, SF, "documents")
    frames = [docs]
    for name, stage in p.STAGES:
        frames.append(durable(stage(spark, frames[-1], SF)))
        if name != "sentencepiece":
            assert frames[-1].columns == docs.columns
    sizes = [f.count() for f in frames]
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5] > 0
    assert sizes[1] >= 0.7 * sizes[0]
    assert exact.dedup(frames[2]).where("NOT kept").isEmpty()
    assert neardup.link(frames[3]).where("NOT kept").isEmpty()
    ids = frames[5].where("n_tokens <> size(ids)")
    assert ids.isEmpty()
    assert sorted(map(tuple, p.run(spark, SF).select("doc_id", "n_tokens").collect())) == sorted(map(tuple, frames[5].select("doc_id", "n_tokens").collect()))


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
