"""The pipeline's stages one after the other, and the registered queries."""

import corpus_pipeline
import pytest
from documents import SCHEMA, edges, frame

import __spark_entry__ as contract
from tradewind.llm.common import store
from tradewind.llm.queries import QUERIES


def test_registered():
    names = list(contract.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_stages_over_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n, text = docs.columns, docs.count(), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, store(stage(spark, docs, sf_dir), "stage")
        if k < 4:
            assert docs.columns == columns
        if k < 2:
            assert 0 < docs.count() < n
            assert docs.join(before, columns, "left_anti").count() == 0
            n = docs.count()
        elif k == 2:
            assert docs.count() == n
            text = {r.doc_id: r.text for r in docs.collect()}
        elif k == 3:
            assert all(r.text == text[r.doc_id] for r in docs.collect())
    assert docs.where("n_tokens <> size(ids)").count() == 0
    found = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, found.collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("rows", [edges(), []], ids=["edges", "empty"])
def test_stages_over_edges(spark, rows):
    docs = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, ""), "stage")
    assert (docs.count() > 0) == bool(rows)


# These report on languages or items.
NO_ROW_PER_ROW = ("pipeline", "op11_best_positions", "op12_son_collocations")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in NO_ROW_PER_ROW])
def test_queries_return_a_row_per_row(spark, sf_dir, name):
    table = {"op4": "pages", "op9": "conversations"}.get(name.split("_")[0], "documents")
    found, n = QUERIES[name](spark, sf_dir).count(), spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert found >= n if name.startswith("op9") else found == n
