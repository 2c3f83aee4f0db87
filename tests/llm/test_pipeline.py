import os

import pytest

import corpus_pipeline
from pagetide.llm import queries
from pagetide.llm.common import materialize

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), f"test-{name}")
        if name != "bpe":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.count() == before and {"doc_id", "n_tokens", "ids", "decoded"} == set(docs.columns)


def test_every_operator_has_a_query():
    names = set(queries.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def empty_like(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0), (7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "consectetur lorem IPSUM dolor sit amet"), (2, None), (3, "")], "item_id int, text string")
    for name, df in (("documents", odd_docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_stages_take_odd_and_empty_tables(spark, odd_docs, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing column names go through every stage; so does a table without rows."""
    folder = empty_like(spark, odd_docs, tmp_path)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd_docs, folder)
        left[name] = sorted((r["doc_id"] or 0) for r in got.collect())
        if name != "bpe":
            assert got.columns == odd_docs.columns and got.schema["deleted"].dataType == odd_docs.schema["deleted"].dataType
            assert {r["deleted"] for r in got.collect()} <= {"k"}
        assert stage(spark, odd_docs.limit(0), folder).count() == 0
    assert left["line_dedup"] == left["bpe"] == sorted((r["doc_id"] or 0) for r in odd_docs.collect())
    assert left["near_dedup"] == [1, 3, 4, 6, 8, 9]  # 1: no word; 3: a b c
    assert left["decontamination"] == sorted(x for x in left["bpe"] if x != 4)


def test_run_takes_empty_tables(spark, odd_docs, tmp_path):
    folder = empty_like(spark, odd_docs.limit(0), tmp_path)
    assert corpus_pipeline.run(spark, folder).count() == 0
