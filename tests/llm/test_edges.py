"""Every operator over nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest

import corpus_pipeline
from gridloom.llm.queries import QUERIES

from .conftest import ROWS

EXPECTED = {"op2_urls": 9, "op4_chat": 6, "op12_phrases": 0, "op13_codes": 101}


@pytest.mark.parametrize("name", list(QUERIES))
def test_edges(spark, sf, name):
    got = QUERIES[name](spark, sf).collect()
    if name == "op6_packing":
        assert {r.doc_id for r in got} == {r[0] for r in ROWS} and len(got) > len(ROWS)
    else:
        assert len(got) == EXPECTED.get(name, len(ROWS))


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == (1 if name == "op4_chat" else 0)


def test_pipeline_edges(spark, sf, empty):
    from gridloom.sources.tables import materialize

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, sf))
        counts.append(docs.count())
        assert k == 4 or docs.columns == columns
    assert counts[0] == len(ROWS) - 3 and counts[1] < counts[0] and counts[2] == counts[1] and counts[4] >= counts[3] > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
