"""Every registered query against its SQL on whole tables, in the plain and in the chunked plan."""

import functools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from emberlog.plans import suite
from emberlog.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
QUERIES = dict(suite.QUERIES)
TEXT_QUERIES = sorted(name for name in QUERIES if name.startswith("text_")) + ["keyword_any", "keyword_spans_docs"]
LINE_QUERIES = sorted(set(QUERIES) - {"sorted_listing", "file_quarantine", *TEXT_QUERIES})


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def same(spark, sql, name):
    frame = QUERIES[name](spark, SF)
    result = sql.execute(ORACLE[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(result.fetchall(), key=repr)
    assert sorted((tuple(r) for r in frame.select(*names).collect()), key=repr) == want
    return want


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    assert same(spark, sql, name)


@pytest.mark.parametrize("name", LINE_QUERIES)
def test_query_with_containers_too_large_for_one_task(spark, sql, name, monkeypatch):
    monkeypatch.setattr(suite, "LogView", functools.partial(suite.LogView, rows_per_chunk=20))
    assert suite.LogView(spark, SF).is_cut
    assert same(spark, sql, name)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 33


def test_sorted_results(spark):
    assert [r.c_name for r in QUERIES["sorted_listing"](spark, SF).collect()] == sorted(
        r.c_name for r in spark.read.parquet(f"{SF}/customer.parquet").collect()
    )
    ids = [r.container_id for r in QUERIES["container_summary"](spark, SF).collect()]
    assert ids == sorted(ids)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plain_record_assembly_shuffles_once(spark):
    for name in ("record_assembly", "level_gap_merge", "error_pattern_hits"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert plan.count("Exchange hashpartitioning") == 1, name
        assert "Python" not in plan


def test_whole_texts_are_not_shuffled(spark):
    for name in sorted(set(TEXT_QUERIES) - {"text_containers"}):
        assert "Exchange" not in plan_of(QUERIES[name](spark, SF)), name


def test_counts_shuffle_no_text(spark):
    for name in ("header_flag", "level_counts", "container_summary", "report_json", "keyword_container", "pattern_summary", "pattern_summary_merged", "container_dedup", "run_accumulate"):
        execution = QUERIES[name](spark, SF)._jdf.queryExecution()
        plan = spark._jvm.PythonSQLUtils.explainString(execution, "formatted")
        moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
        assert moved and not any(re.search(r"\b(line|props|record|raw)#", columns) for columns in moved), name
        assert "collect_list" not in plan, name


def test_runs_that_differ_are_both_read(spark):
    frame = QUERIES["container_dedup"](spark, SF)
    assert "Union" in frame._jdf.queryExecution().optimizedPlan().toString()


def test_scans_read_only_the_columns_they_need(spark):
    plan = plan_of(QUERIES["keyword_spans_docs"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = plan_of(QUERIES["header_flag"](spark, SF).select(F.col("n_header")))
    assert "value:double" not in plan
