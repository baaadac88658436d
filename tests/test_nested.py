"""The nested report: bounds of its parts, nothing lost, and what a small plan promises."""

import json

from pyspark.sql import functions as F

from emberlog.plans import nested

ENTRY = "container_id string, section string, ord long, text string"


def entries(spark):
    rows = [("a", "container", 0, None), ("b", "container", 0, None)]
    rows += [("a", "ERROR", i, f"ERROR Executor {'x' * (i * 7 % 90)}") for i in range(200)]
    rows += [("a", "WARN", i, "") for i in range(300)]
    rows += [("a", "Keyword", 1, "y" * 500), ("a", "INFO", 1, "Caused by: z")]
    return spark.createDataFrame(rows, ENTRY).repartition(3), rows


def chars(row):
    lists = [row.Keyword, *row.res, *row.SpecificError.values(), *row.SpecificWarn.values()]
    return sum(len(text) + 1 for texts in lists for text in texts)


def test_parts_keep_the_bound_and_lose_nothing(spark):
    frame, given = entries(spark)
    for chunk in (False, True):
        rows = nested.nested(frame, 700, chunk=chunk, rows_per_chunk=10).collect()
        assert all(chars(r) <= 700 for r in rows) and len(rows) > 20
        rows.sort(key=lambda r: (r.container_id, r.part_no))
        for level in ("ERROR", "WARN", "INFO"):
            assert [t for r in rows for t in r.res[level]] == [t for c, s, _, t in given if s == level]
        assert [t for r in rows for t in r.SpecificError.get("ERROR Executor", [])] == [t for _, s, _, t in given if s == "ERROR"]
        empty = [r for r in rows if r.container_id == "b"]
        assert len(empty) == 1 and chars(empty[0]) == 0 and empty[0].SpecificWarn == {}
        assert {(r.resLen, r.KeywordLen, r.flag) for r in rows} == {(sum(len(t) for _, s, _, t in given if s in ("ERROR", "WARN", "INFO")), 500, 0)}


def test_a_text_over_the_bound_is_a_part_of_its_own(spark):
    frame, _ = entries(spark)
    rows = nested.nested(frame, 100).collect()
    assert all(chars(r) <= 100 or sum(map(len, (r.Keyword, *r.res))) + len(r.SpecificError) <= 1 for r in rows)


def test_spans_over_their_limit(spark):
    frame, _ = entries(spark)
    told = nested.nested(frame, max_keyword_chars=499).collect()
    assert {r.flag for r in told} == {1} and sum(len(r.Keyword) for r in told) == 1
    kept_back = nested.nested(frame, max_keyword_chars=499, withhold=True).collect()
    assert {(r.flag, r.KeywordLen) for r in kept_back} == {(1, 0)} and not any(r.Keyword for r in kept_back)


def test_documents_have_sorted_keys(spark):
    frame, _ = entries(spark)
    found = nested.documents(nested.nested(frame)).collect()
    assert len(found) == 2

    def check(value):
        if isinstance(value, dict):
            assert list(value) == sorted(value)
            for inner in value.values():
                check(inner)

    for row in found:
        check(json.loads(row.json))


def test_empty(spark):
    assert nested.nested(spark.createDataFrame([], ENTRY)).collect() == []


def test_no_container_is_sorted_in_one_task_when_chunked(spark):
    frame, _ = entries(spark)
    plan = nested.with_parts(nested.report.placed(frame), 700, True, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 2 and "CollectList" not in plan
    assert nested.with_parts(nested.report.placed(frame), 700, True, 10).agg(F.count("*")).first()[0] == 200 * 2 + 300 + 4
