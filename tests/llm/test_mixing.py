import re

import pytest

from emberlog.llm import mixing

from odd_rows import SF


def plain_targets(sizes, cap=3):
    """``sizes`` by source, in code point order: shares by weight, the excess over the limits shared again and again."""
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    target, left = {}, dict(weight)
    total = sum(sizes.values())
    while True:
        rest = total - sum(target.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        above = [s for s in left if share[s] > cap * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = cap * sizes[s]
            del left[s]


def check(docs, rows):
    """A source may miss its target by its smallest document for each chunk that it has, or by half a percent."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source_of, sizes, smallest, number = {}, {}, {}, {}
    for doc_id, text, source in docs:
        source_of[doc_id] = source
        sizes[source] = sizes.get(source, 0) + size(text)
        number[source] = number.get(source, 0) + 1
        if size(text):
            smallest[source] = min(smallest.get(source, size(text)), size(text))
    target, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    assert len(rows) == len(docs)
    assert sorted(((r.doc_id, r.size) for r in rows), key=str) == sorted(((d, size(t)) for d, t, _ in docs), key=str)
    for r in rows:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[source] += r.taken
    for source, words in taken.items():
        chunks = -(-number[source] // mixing.CHUNK)
        assert abs(words - target[source]) <= 1 + max(0.005 * target[source], chunks * smallest.get(source, 0)), source


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(rows) == sorted(again)


def test_small_source_stops_at_its_limit(spark):
    docs = [(i, "a " * (i % 37 + 1), "big") for i in range(3000)] + [(5000 + i, "a b c", "small") for i in range(40)] + [(9000, "x y", None), (9001, None, "void")]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    check(docs, rows)
    assert {r.taken for r in rows if 5000 <= r.doc_id < 6000} == {9}


def test_larger_documents_are_tilted_more(spark):
    docs = [(i, "a " * (1 + i % 50), "s") for i in range(2000)] + [(10_000 + i, "a " * (1 + i % 50), "t") for i in range(2000)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    for low, high, up in ((0, 10_000, False), (10_000, 20_000, True)):  # targets 2/3 and 4/3 of the size
        rates = {r.size: r.rate for r in rows if low <= r.doc_id < high}
        ordered = [rates[s] for s in sorted(rates)]
        assert ordered == sorted(ordered, reverse=not up) and all(0 < x <= 3 for x in ordered)


def test_many_sources(spark):
    docs = [(i, "word " * (1 + i * 7 % 23), f"s{i % 700:03}") for i in range(7000)]
    check(docs, mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect())


def test_odd_rows(spark, odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and {r.taken for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix(nothing).collect() == []
    blank = mixing.mix(odd.where("doc_id in (2, 3, 4)")).collect()
    assert {(r.size, r.target, r.taken) for r in blank} == {(0, 0.0, 0)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def steps_of(spark, docs, monkeypatch):
    """How many Newton steps ``docs`` take, and the rows."""
    taken = []
    real = mixing.cut

    def counted(df):
        if df.columns == ["name", "target", "scale", "tilt", "low", "high", "missed"]:
            taken.append(1)
        return real(df)

    monkeypatch.setattr(mixing, "cut", counted)
    rows = mixing.mix(docs).collect()
    return len(taken) - 1, rows


def test_few_steps_beside_tiny_sources(spark, monkeypatch):
    docs = [(1, "one two three", "a"), (2, "one two", "a"), (3, "x", "b"), *[(10 + i, "w " * (1 + i * 37 % 400), "c") for i in range(500)]]
    steps, _ = steps_of(spark, frame(spark, docs), monkeypatch)
    assert steps <= 12
    steps, _ = steps_of(spark, frame(spark, docs[:2]), monkeypatch)
    assert steps <= 12


def test_rates_solve_the_dual(spark):
    """Rates against a multiplier found by plain bisection of each source."""
    import math

    docs = [(i, "w " * (1 + i * i % 97), "abc"[i % 7 % 3]) for i in range(400)]
    rows = mixing.mix(frame(spark, docs)).collect()
    size = {i: 1 + i * i % 97 for i, _, _ in docs}
    sizes = {s: sum(size[i] for i, _, x in docs if x == s) for s in "abc"}
    target = plain_targets(sizes)
    for source in "abc":
        own = [size[i] for i, _, x in docs if x == source]
        low, high = -50.0, 50.0
        for _ in range(200):
            tilt = (low + high) / 2
            got = sum(s * min(3.0, math.exp(min(50.0, tilt * s / 97))) for s in own)
            low, high = (tilt, high) if got < target[source] else (low, tilt)
        for r in rows:
            if docs[r.doc_id][2] == source and target[source] < 3 * sizes[source] * (1 - 1e-9):
                assert abs(r.rate - min(3.0, math.exp(tilt * size[r.doc_id] / 97))) < 1e-3


def test_repeated_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    docs = [(None, "same text here", "a")] * 1000 + [(i, "w " * (i % 30 + 1), "b") for i in range(300)]
    rows = mixing.mix(frame(spark, docs)).collect()
    assert len(rows) == 1300 and sum(r.doc_id is None for r in rows) == 1000
    sizes = {"a": 3000, "b": sum(i % 30 + 1 for i in range(300))}
    target = plain_targets(sizes)
    assert abs(sum(r.taken for r in rows if r.doc_id is None) - target["a"]) <= 3 * 1000 / 50
    plan = mixing.mix(frame(spark, docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "explode" in plan


def test_a_column_of_that_name_is_kept(spark, tmp_path):
    docs = frame(spark, [(1, "a b c", "s"), (2, "d e", "s")]).selectExpr("*", "7 as Mix_Copies", "8 as mix_copies_before")
    kept = mixing.apply(docs)
    kept.write.parquet(str(tmp_path / "out"))
    assert kept.columns[-1] == "mix_copies" and "Mix_Copies_before_before" in kept.columns
