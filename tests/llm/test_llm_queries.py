"""The registered queries against SQL where there is any, and the pipeline against its parts."""

from __future__ import annotations

import os

import compare
import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as contract
from parcella.llm import minmax, pii, queries
from parcella.llm.common import Scratch

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, sf, spark):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    assert not compare.differences(queries.QUERIES[name](spark, sf), con, queries.ORACLE_SQL[name])


def test_all_are_registered():
    found = contract.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in found) == 1
    assert "pipeline" in found
    assert set(queries.ORACLE_SQL) <= set(contract.oracle_sql())


def test_pipeline_stages(spark, tmp_path_factory):
    """Each stage keeps exactly what its own decisions, taken apart, leave."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch, ids = Scratch(spark, "test"), {r["doc_id"] for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.write(stage(spark, docs, sf), name)
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert kept <= ids
        if name == "near_duplicates":
            groups = minmax.near_duplicates(docs).collect()
            assert kept == {r["doc_id"] for r in groups if r["kept"]}
        if name in ("personal_data", "pieces"):
            assert kept == ids
        if name == "personal_data":
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            for r in out.collect():
                rows = [{"kind": k, "start": a, "stop": b} for k, a, b, _ in pii.spans_of(before[r["doc_id"]])]
                assert r["text"] == pii.masked(before[r["doc_id"]], rows) and r["n_chars"] == len(r["text"])
        assert out.columns == columns + (["ids"] if name == "pieces" else [])
        docs, ids = out, kept


def test_pipeline_odd_rows(spark, odd_documents, tmp_path):
    sf = str(tmp_path)
    odd_documents.drop("ids").write.parquet(os.path.join(sf, "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind is in there at all")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = corpus_pipeline.run(spark, sf)
    kept = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert sorted(i for i in kept if i) == [1, 1, 3, 5, 6, 7, 9, 10, 11, 12, 13] and kept.count(None) == 2


def test_pipeline_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
