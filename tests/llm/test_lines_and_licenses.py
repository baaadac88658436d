from emberlog.llm import licenses, line_dedup


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def dedup(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in line_dedup.drop_recurring(docs).collect()}


def test_recurring_templates(spark):
    rows = [
        (1, "alpha beta gamma\nprinted 12 pages on host a7 today\nown line one here"),
        (2, "printed 9 pages on host b today\nsecond text of its own"),
        (3, "third\n\nprinted 400 pages on host c9 today"),
        (4, "printed 9 pages on host b today\nsecond text of its own"),  # a copy of 2
        (5, "twice only\nprinted nothing at all"),
        (6, "twice only\nfine"),
    ]
    found = dedup(spark, rows)
    assert found[1].text == rows[0][1] and found[1].n_segments == 3  # the first keeps it
    assert found[2].text == found[4].text == "second text of its own"
    assert found[3].text == "third\n\n" and found[3].n_dropped == 1
    assert found[5].text == rows[4][1] and found[6].text == rows[5][1]  # short ones need three documents


def test_a_document_has_one_vote(spark):
    """However many segments of a leaf one document has, its values alone are no constants."""
    shared = ["user aa bb cc dd blue hall", "user aa bb cc dd green lake"]
    for own in (["user aa bb cc dd red room"], [f"user aa bb cc dd red room{'x' * i}" for i in range(3)]):
        found = dedup(spark, [(1, "\n".join(own)), (2, shared[0]), (3, shared[1])])
        assert (found[1].n_dropped, found[2].n_dropped, found[3].n_dropped) == (0, 1, 1)


def test_fields_with_frequent_and_rare_values_are_one_template(spark):
    names = ["alice"] * 3 + ["bob"] * 3 + ["carol", "dave"]
    rows = [(i, f"on this day user {name} came in from {'home' if i % 2 else f'place{chr(97 + i) * 3}'}\nown text {'z' * (i + 1)}") for i, name in enumerate(names)]
    assert [r.n_dropped for _, r in sorted(dedup(spark, rows).items())] == [0] + [1] * 7


def test_boilerplate_among_other_lines_of_its_leaf(spark):
    rows = [(i, f"one two three four five six {'abc'[i % 3]} ends {'def'[i % 3] * 3} here {'ghi'[i % 3] * 4} {'jkl'[i % 3] * 2}\nown {'y' * (i + 1)}") for i in range(9)]
    assert sum(r.n_dropped for r in dedup(spark, rows).values()) >= 6


def test_two_documents_are_enough_for_long_segments(spark):
    long, short = "this notice has quite enough words", "only three words"
    found = dedup(spark, [(1, f"{long}\n{short}\na"), (2, f"b\n{short}\n{long}")])
    assert found[2].text == f"b\n{short}\n" and found[1].n_dropped == 0


def test_copies_keep_what_the_first_keeps(spark):
    line = "a line of several words that recurs"
    found = dedup(spark, [(1, f"{line}\nx"), (5, f"{line}\nx"), (9, f"{line}\nother")])
    assert found[1].text == found[5].text == f"{line}\nx" and found[9].text == "other"


def test_passages_inside_longer_lines(spark):
    """Of passages of over 50 words that two or more documents share, nearly all words go from all but one of them."""
    import random

    draw = random.Random(3)
    word = lambda: "".join(draw.choice("bcdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randrange(1, 4)))
    sentence = lambda: " ".join(word() for _ in range(draw.randrange(6, 18))).capitalize() + draw.choice([".", ".", "!", "?"])

    def passage(words):
        out = []
        while len(" ".join(out).split()) < words:
            out.append(sentence())
        return " ".join(out)

    passages = [passage(60 + 10 * (i % 5)) for i in range(30)]
    rows, where = [], {}
    for i in range(90):
        before, after = passage(30), passage(30)
        mine = passages[i % 30] if i < 75 else ""
        rows.append((i, f"{before} {mine} {after}\nlast line {'z' * (i + 1)}"))
        if i >= 30 and mine:
            where[i] = (mine, before, after)
    found = dedup(spark, rows)
    lost = total = 0
    for i, (mine, before, after) in where.items():
        left = found[i].text
        total += len(mine.split())
        lost += len(rows[i][1].split()) - len(left.split())
        assert before.rsplit(". ", 1)[0] in left and "last line" in left
    assert lost >= 0.9 * total
    assert all(found[i].n_dropped == 0 for i in range(30)) and all(found[i].n_dropped == 0 for i in range(75, 90))


def test_copies_alone_do_not_make_a_line_recur(spark):
    docs = spark.createDataFrame([(i, "the same line of text\nand one more") for i in range(5)], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.drop_recurring(docs).collect()} == {0}


def test_one_document_with_many_equal_lines(spark):
    docs = spark.createDataFrame([(1, "again and again\n" * 500), (2, "other"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: (r.n_segments, r.n_dropped) for r in line_dedup.drop_recurring(docs).collect()}
    assert found == {1: (500, 0), 2: (1, 0), 3: (0, 0)}


def test_a_text_of_many_lines_takes_linear_time(spark):
    import time

    shared = "a shared line of boilerplate with words"
    text = "\n".join(f"line {chr(97 + i % 26)} of a long text of its own {i}" if i % 1000 else shared for i in range(200_000))
    start = time.time()
    found = dedup(spark, [(2, text), (1, shared + "\nx"), (3, "y")])
    assert time.time() - start < 60
    assert found[2].n_dropped == 200 and found[2].text == "\n".join(t for t in text.split("\n") if t != shared)


def test_shape_of_the_plan_is_the_same_at_every_size(spark):
    """No step is chosen by a count: texts are joined by their hash, without a hint to broadcast."""
    for n in (2, 2000):
        docs = spark.range(n).selectExpr("id as doc_id", "concat('a line of boilerplate for all ', id % 3, '\nown ', id) as text")
        logical = line_dedup.drop_recurring(docs)._jdf.queryExecution().optimizedPlan().toString()
        assert "broadcast" not in logical and "LeftOuter" in logical


def test_texts_are_parsed_once(spark, monkeypatch):
    parsed = []
    parse = line_dedup.segments
    monkeypatch.setattr(line_dedup, "segments", lambda *args: parsed.append(args) or parse(*args))
    lines = [f"this day user {name} came in from home" for name in ("ann", "bob", "cid", "dan")]
    found = dedup(spark, [(i, f"{line}\nown {'z' * (i + 1)}") for i, line in enumerate(lines)])
    assert [found[i].n_dropped for i in range(4)] == [0, 1, 1, 1] and len(parsed) == 1


def test_documents_that_lose_all_go(spark):
    docs = spark.createDataFrame([(1, "shared line of text\nown", 23), (2, "shared line of text", 19), (3, "shared line of text\nrest", 24), (4, "", 0)], "doc_id long, text string, n_chars int")
    rows = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.keep_rest(docs).collect()}
    assert rows == {1: ("shared line of text\nown", 23), 3: ("rest", 4), 4: ("", 0)}


def test_odd_lines(spark, odd, nothing):
    rows = line_dedup.drop_recurring(odd).collect()
    assert len(rows) == odd.count() and {r.n_dropped for r in rows} == {0}
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(((r.doc_id, r.text) for r in odd.collect()), key=str)
    assert line_dedup.drop_recurring(nothing).collect() == []


def test_no_python_in_native_plans(spark, odd):
    for frame in (line_dedup.drop_recurring(odd), licenses.scan(odd)):
        assert "Python" not in plan_of(frame) and "Arrow" not in plan_of(frame)


def licence(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(docs).collect()}


def test_base_phrases(spark):
    rows = licence(spark, "x CC-BY y cc by z", "ALL rights. reserved!", "the General-Public\nLicense", "ccby cc0 by", "general public licenses", None, "É cc by", "all rights all rights reserved")
    assert [(rows[i].n_words, rows[i].n_base, rows[i].first_word, rows[i].last_word, rows[i].base_labels) for i in range(8)] == [
        (7, 2, 1, 4, "cc-by"), (3, 1, 0, 0, "reserved"), (4, 1, 1, 1, "gpl"), (3, 0, None, None, ""), (3, 0, None, None, ""),
        (0, 0, None, None, ""), (3, 1, 1, 1, "cc-by"), (5, 1, 2, 2, "reserved"),
    ]
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_notices_by_position(spark):
    filler = "the of and to in a is that " * 30
    rows = licence(
        spark, filler + "Released under the MIT License." + filler, "Licensed under the Apache License, Version 2.0", "license apache version under licensed",
        "licensed under the GNU General Public License, version 3", "licensed under the GNU General Public License, version 2", "Licensed under CC BY-NC 4.0", filler, "Released under my MIT License",
    )
    assert [rows[i].labels for i in range(8)] == ["mit", "apache-2.0", "", "gpl,gpl-3.0", "gpl,gpl-2.0", "cc-by,cc-by-nc-4.0", "", "mit"]
    assert rows[0].score == 1.0 and 0.8 <= rows[7].score < 1 and rows[6].score == 0


def test_odd_texts(spark, odd, nothing):
    rows = licenses.scan(odd).collect()
    assert len(rows) == odd.count() and {r.labels for r in rows} == {""}
    assert licenses.scan(nothing).collect() == []
    many = licence(spark, "license apache " * 3000 + "Licensed under the Apache License, Version 2.0 " * 50)
    assert many[0].labels == "apache-2.0" and many[0].n_words == 6000 + 50 * 8
