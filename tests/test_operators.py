"""Operators against an independent line machine, on random lines and in both plans."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.catalogue import ERROR_PHRASES, WARN_PHRASES
from emberlog.functions import text as fx
from emberlog.operators import containers, keywords, patterns, records
from emberlog.operators.ordering import cut_large_groups, running_counts

import line_machine as machine

LINES = st.sampled_from(
    [
        *[f"20/06/06 22:25:17 {level} A: needle" for level in ("ERROR", "WARN", "INFO", "DEBUG")],
        *[f"2020-06-06 22:25:17 {level} B: x" for level in ("ERROR", "WARN", "INFO", "FATAL")],
        "\tat needle",
        "\tCaused by: x",
        "rest",
        "",
        " ",
        "20/06/06\tx\x1cINFO y\r",
        "Needle 20/06/06",
    ]
)
TEXTS = st.lists(st.lists(LINES, max_size=14).map("\n".join), min_size=20, max_size=60)
SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def frames(spark, texts):
    named = [(f"c{i:03d}", text) for i, text in enumerate(texts)]
    files = spark.createDataFrame(named, "container_id string, value string").repartition(3)
    lines = files.select("container_id", F.posexplode(F.split("value", "\n", -1)).alias("n", "line")).repartition(5)
    return dict(named), files, lines


@pytest.mark.parametrize("chunked", [False, True])
def test_random_lines(spark, chunked):
    @SETTINGS
    @given(TEXTS)
    def check(texts):
        named, files, lines = frames(spark, texts)
        if chunked:
            lines, was_cut = cut_large_groups(lines, "container_id", [F.col("n")], 3)
            assert was_cut == any(text.count("\n") >= 3 for text in texts)
            chunked_now = was_cut
        else:
            chunked_now = False
        pieces = records.pieces_from_lines(lines, ["n"], "chunk" if chunked_now else None)
        columns = ["container_id", "rec_no", "level", "raw"]
        expected = sorted((c, *piece) for c, text in named.items() for piece in machine.pieces(text))
        by_place = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: r[:2])
        assert by_place(pieces.select(columns).collect()) == expected
        assert by_place(records.pieces_from_text(files).select(columns).collect()) == expected

        expected = sorted((c, i, *s) for c, text in named.items() for i, s in enumerate(machine.segments(text), 1))
        merged = records.merge_gaps(records.records(pieces), chunked_now, 2)
        assert by_place(merged.select("container_id", "seg", "level", "record").collect()) == expected
        assert by_place(records.segments_from_text(files).collect()) == expected

        expected = sorted((c, i, h) for c, text in named.items() for i, h in enumerate(machine.spans(text, ["needle"]), 1))
        found = keywords.spans(pieces, "needle,rest", "first", chunk=chunked_now, rows_per_chunk=2)
        assert by_place(found.select("container_id", "hit_no", "hit").collect()) == expected
        narrow = keywords.spans_from_text(files, "needle,rest", "first")
        assert by_place(narrow.select("container_id", "hit_no", "hit").collect()) == expected

    check()


def test_any_keyword_matches_each_of_them(spark):
    texts = ["20/06/06 a ERROR one\nx\n\ttwo\n20/06/06 a WARN three", "\ttwo"]
    named, files, lines = frames(spark, texts)
    for match, words in (("first", ["one"]), ("any", ["one", "two"])):
        found = keywords.spans_from_text(files, "one,,two", match).orderBy("container_id", "hit_no").collect()
        assert [r.hit for r in found] == [h for text in named.values() for h in machine.spans(text, words)]
    for wrong in (("a", "all"), ("a,b",)):
        with pytest.raises(ValueError):
            fx.parse_keywords(*wrong)


def test_running_counts_with_one_container_holding_most_rows(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), F.col("id").alias("at")
    )
    # A burst: half of the large key sits in a small part of the range.
    df = df.withColumn("at", F.when(F.col("at") < 2000, F.col("at") * 1_000_000).otherwise(2 * 10**9 + F.col("at")))
    cut, was_cut = cut_large_groups(df, "k", [F.col("at")], 100)
    assert was_cut
    assert cut.groupBy("k", "chunk").count().agg(F.max("count")).first()[0] <= 100
    got = running_counts(cut, "k", ["at"], "chunk", totals=True, n=F.lit(1), even=F.col("at") % 2 == 0)
    want = running_counts(df, "k", ["at"], None, totals=True, n=F.lit(1), even=F.col("at") % 2 == 0)
    columns = ["k", "at", "n", "even", "n_total", "even_total"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_burst_at_one_position_is_cut_by_the_next_one(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.lit(7).cast("long").alias("at"), F.col("id").alias("no"))
    cut, was_cut = cut_large_groups(df, "k", [F.col("at"), F.col("no")], 100)
    assert was_cut and cut.groupBy("chunk").count().agg(F.max("count")).first()[0] <= 100
    got = running_counts(cut, "k", ["at", "no"], "chunk", n=F.lit(1))
    assert got.filter("n != no + 1").count() == 0


def test_small_groups_are_not_cut(spark):
    df = spark.range(50).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    same, was_cut = cut_large_groups(df, "k", [F.col("at")], 50)
    assert not was_cut and same is df


def test_phrases(spark):
    rows = [
        ("c1", 1, "ERROR", "x ERROR Executor: y"),
        ("c1", 2, "ERROR", "ERROR TaskSetManager Job aborted due to stage failure"),
        ("c2", 1, "WARN", "ERROR Executor WARN TaskSetManager"),
        ("c2", 2, "WARN", "warn tasksetmanager"),
        ("c2", 3, "INFO", "ERROR Executor"),
        ("c3", 0, None, "ERROR Executor"),
    ]
    recs = spark.createDataFrame(rows, "container_id string, rec_no bigint, level string, record string")
    hit = sorted((r.kind, r.pattern_no, r.container_id, r.rec_no) for r in patterns.all_hits(recs).collect())
    assert hit == [("ERROR", 0, "c1", 2), ("ERROR", 1, "c1", 2), ("ERROR", 2, "c1", 1), ("WARN", 17, "c2", 1)]
    assert patterns.hits(recs, "WARN").count() == 1
    summary = patterns.summary(patterns.all_hits(recs)).collect()
    assert len(summary) == len(ERROR_PHRASES) + len(WARN_PHRASES) == 33
    assert sum(r.n_records for r in summary) == 4
    assert sum(1 for r in summary if r.n_records == 0) == 29


def fingerprints(recs, **options):
    """Of records that are given with their texts."""
    text = F.col("record")
    hashes = [F.xxhash64(F.lit(seed), text).alias(f"hash_{seed}") for seed in records.SEEDS]
    facts = recs.select("container_id", F.col("rec_no").alias("seg"), "level", F.length(text).cast("long").alias("n_chars"), F.contains(text, F.lit("Caused by:")).alias("cause"), *hashes)
    return containers.fingerprinted(facts, **options)


def test_accumulate_keeps_changed_entries(spark):
    schema = "container_id string, rec_no bigint, level string, record string"
    one = spark.createDataFrame([("a", 1, "ERROR", "x"), ("b", 1, "WARN", "y"), ("p", 0, None, "z")], schema)
    two = spark.createDataFrame([("a", 1, "ERROR", "x"), ("b", 1, "WARN", "other"), ("c", 1, "INFO", "no")], schema)
    both = containers.accumulate(fingerprints(one), fingerprints(two))
    assert sorted(r.container_id for r in both.collect()) == ["a", "b", "b", "c", "p"]
    swapped = spark.createDataFrame([("a", 1, "ERROR", "x"), ("a", 2, "ERROR", "y")], schema)
    order = spark.createDataFrame([("a", 1, "ERROR", "y"), ("a", 2, "ERROR", "x")], schema)
    assert containers.accumulate(fingerprints(swapped), fingerprints(order)).count() == 2
    # Records that are in no list have no effect, whatever their number.
    with_more = spark.createDataFrame([("a", 1, "INFO", "no"), ("a", 2, "ERROR", "x"), ("a", 3, "DEBUG", "no"), ("a", 4, "ERROR", "y")], schema)
    assert containers.accumulate(fingerprints(swapped), fingerprints(with_more)).count() == 1
    for rows_per_chunk in (1, 2, 3):
        cut = fingerprints(with_more, chunk=True, rows_per_chunk=rows_per_chunk)
        assert sorted(cut.collect()) == sorted(fingerprints(with_more).collect())


def test_hashes_of_lines_stand_for_texts(spark):
    """Containers have equal fingerprints if and only if their merged records are equal, in both plans."""
    draw = random.Random(17)
    parts = ["20/06/06 x ERROR a", "20/06/06 x WARN b", "20/06/06 x INFO Caused by: c", "20/06/06 x DEBUG d", "\tat e", "\tat f", ""]
    logs = {f"c{i}": [draw.choice(parts) for _ in range(draw.randrange(1, 5))] for i in range(400)}
    lines = spark.createDataFrame([(c, n, n // 3, line) for c, ls in logs.items() for n, line in enumerate(ls)], "container_id string, at bigint, part bigint, line string")
    ids = lines.select("container_id").distinct()
    both = []
    for chunk in (None, "part"):
        facts = records.line_facts(lines, ["at"], chunk, hashes=True)
        merged = records.merged_facts(facts, chunk is not None, 2)
        both.append({r.container_id: tuple(r)[1:] for r in containers.fingerprinted(merged, "seg", chunk is not None, 2, ids).collect()})
    assert both[0] == both[1] and set(both[0]) == set(logs)
    pieces = records.records(records.pieces_from_lines(lines, ["at"]))
    lists = {c: {"ERROR": [], "WARN": [], "INFO": []} for c in logs}
    for r in sorted(records.kept(records.merge_gaps(pieces).withColumnRenamed("seg", "rec_no")).collect(), key=lambda r: r.rec_no):
        lists[r.container_id][r.level].append(r.record)
    texts = {c: repr(found) for c, found in lists.items()}
    assert len(set(texts.values())) == len(set(both[0].values())) == len({(texts[c], both[0][c]) for c in logs}) > 50


def test_facts_of_lines_are_those_of_records(spark):
    lines = [
        ("c1", 1, "\tat b"), ("c1", 2, "20/06/06 x ERROR Executor: y"), ("c1", 3, "Job aborted due to stage failure"),
        ("c1", 4, "20/06/06 x INFO z"), ("c1", 5, "\tCaused by: q"), ("c2", 1, "20/06/06 x WARN TaskSetManager"),
    ]
    df = spark.createDataFrame(lines, "container_id string, n long, line string")
    recs = records.records(records.pieces_from_lines(df, ["n"]))
    facts = records.line_facts(df, ["n"], keywords=["caused by"])
    assert sorted(containers.summary_of_facts(facts).collect()) == sorted(containers.summary(recs).collect())
    by_phrase = lambda found: sorted(map(tuple, patterns.summary(found).collect()))
    assert by_phrase(patterns.hits_of_facts(facts)) == by_phrase(patterns.all_hits(recs))
    assert {(r.container_id, r.n_hits) for r in keywords.hits_per_container(facts).collect()} == {("c1", 1), ("c2", 0)}
    with pytest.raises(ValueError):
        records.phrase_mask(F.col("line"), ["a \t b"])


def test_sorted_listing_is_in_key_order(spark):
    people = [("Ada", "Quill"), ("Bo", "Marsh"), ("Cy", "Nettle")]
    df = spark.createDataFrame(people, "fname string, lname string").withColumn("timestamp", fx.now_text())
    rows = containers.sorted_listing(df, "lname").collect()
    assert [r.lname for r in rows] == ["Marsh", "Nettle", "Quill"]
    assert all(len(r.timestamp) == 19 for r in rows)
