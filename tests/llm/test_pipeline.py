"""The pipeline's decisions, stage by stage, over the smallest tables."""

import os

import pytest

import corpus_pipeline
from beaconry.llm.common import cut, table
from test_ngram_join import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs, kept = table(spark, SF, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF))
        kept[name] = docs
        if name == "packing":
            break
        assert docs.columns == columns
        assert docs.select("doc_id", "text").subtract(before.select("doc_id", "text")).isEmpty()
    texts = [(r.doc_id, r.text) for r in kept["language_id"].collect()]
    assert {r.doc_id for r in kept["ngram_join"].collect()} == {c for _, _, c in brute(texts, 5, 80)}
    pieces = kept["packing"].collect()
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    assert sum(p.piece == 0 for p in pieces) == kept["mixing"].count()


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
