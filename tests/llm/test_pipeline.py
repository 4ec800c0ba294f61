"""The pipeline and the queries on the smallest tables."""

import corpus_pipeline
import pyarrow as pa
import pytest

from wideloom.llm import catalog, common

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = catalog.read(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        rows = out.collect()
        assert 0 < len(rows) <= n and len({r.doc_id for r in rows}) == len(rows)
        docs, n = spark.createDataFrame(rows, out.schema), len(rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}
    key = lambda p: (p.doc_id, p.start, p.length, bytes(p.ids))
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, pieces))


def test_texts_reach_python_in_batches_of_bounded_size(spark):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 4000) AS text")
    common.map_rows(docs, lambda c: [], "n bigint").collect()
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n bigint, size bigint").collect()
    assert sum(r.n for r in sizes) == 3000 and max(r["size"] for r in sizes) < 2 * common.BATCH_BYTES


def test_pipeline_of_an_empty_table(spark):
    docs = catalog.read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
