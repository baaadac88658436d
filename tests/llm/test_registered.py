"""Registered queries against SQL, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from emberlog.llm.queries import ORACLE, QUERIES

from odd_rows import SF

TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    sql = duckdb.connect()
    for table in TABLES:
        sql.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    result = sql.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    frame = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(frame.columns)
    assert sorted((tuple(r) for r in frame.select(*names).collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF)
        if name != "source_mixing":
            assert kept.columns == docs.columns
        kept = kept.cache()
        now = {r.doc_id for r in kept.select("doc_id").collect()}
        assert now and now <= ids
        docs, ids = kept, now
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == ids


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, odd, nothing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    kept = stage(spark, odd, SF)
    assert kept.columns[: len(odd.columns)] == odd.columns
    rows = kept.collect()
    assert all(r["odd name"] == 9 and r.row == "r" and r.fp == 8 for r in rows)
    own = {(r.doc_id, r.text) for r in odd.collect()}
    assert {(r.doc_id, r.text) for r in rows} <= own
    assert stage(spark, nothing, SF).collect() == []
