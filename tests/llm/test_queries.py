"""The registered queries: SQL side by side, and the pipeline against its parts."""

from __future__ import annotations

import pytest
from compare import _rows, connect

import __spark_entry__ as entry
import corpus_pipeline
from speechlake.llm import load

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.mark.parametrize("name", sorted(n for n in SQL if n != "pipeline"))
def test_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cursor = connect(SF).execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and n != "pipeline"))
def test_a_row_per_document(spark, name):
    table = "pages" if "url" in name else "documents"
    assert entry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs, SF)
        assert docs_after.columns == docs.columns, name
    out = entry.queries()["pipeline"](spark, SF)
    got = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) < ids


def test_pipeline_encodes_without_moving_documents(spark):
    """The stage whose grouped edges took an executor's memory has no shuffle of its own."""
    out = corpus_pipeline.encoded(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert out.where("decodes_back").count() == out.count() > 0
