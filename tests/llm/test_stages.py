"""Every stage of the pipeline on hard, clashing and empty tables."""

import collections

import pytest

from tests.llm.fixtures import clashing, empty, hard, written

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [hard, empty])
def test_stages_keep_rows_and_columns(spark, tmp_path, make):
    docs = written(spark, make(spark), tmp_path)
    before = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns, name
        got = kept.collect()
        assert clashing(got) and not collections.Counter((r.doc_id, r.text) for r in got) - before, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert collections.Counter(r.doc_id for r in pieces if r.start == 0) == collections.Counter(r.doc_id for r in docs.collect())


def test_run_applies_every_stage(spark, tmp_path):
    """One stage after the other by hand gives what ``run`` gives."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(spark, stage(spark, docs, FOLDER), tmp_path, name)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
