import random

import numpy as np
import pyarrow as pa

from emberlog.llm import decontaminate

from odd_rows import SF


def plain_alignment(a, b):
    best, end = 0, 0
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        if max(row) > best:
            best, end = max(row), row.index(max(row))
        above = row
    return best, end


def test_alignment_against_the_plain_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        assert decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64)) == plain_alignment(a, b)


def test_all_exact_copies_are_found(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, items).collect()}
    for d in docs.collect():
        for i in items.collect():
            if d.text and i.text in d.text:
                assert found[d.doc_id, i.item_id] > 0.99
    assert all(0.5 <= s <= 1 for s in found.values())


def test_edited_copies_and_clean_documents(spark):
    items = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()
    rng = random.Random(2)
    vocabulary = " ".join(r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()).split()
    rows, clean = [], []
    for k, item in enumerate(items):
        own = [rng.choice(vocabulary) for _ in range(300)]
        clean.append((10_000 + k, " ".join(own)))
        edited = [rng.choice(vocabulary) if rng.random() < 0.15 else w for w in item.text.split() if rng.random() > 0.05]
        at = rng.randrange(300)
        rows.append((k, " ".join(own[:at] + edited + own[at:])))
    rows += [(20_000 + i, rows[0][1]) for i in range(300)]  # a passage that many documents have
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame(items)).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert np.mean([(k, item.item_id) in pairs for k, item in enumerate(items)]) > 0.95
    assert not any(10_000 <= d < 20_000 for d, _ in pairs)
    assert {20_000 + i for i in range(300)} <= {d for d, _ in pairs}
    kept = {r.doc_id for r in decontaminate.keep_clean(docs, spark.createDataFrame(items)).collect()}
    assert kept == {d for d, _ in rows + clean} - {d for d, _ in pairs}


def test_place_of_the_passage():
    item = [f"w{i}" for i in range(20)]
    items = decontaminate.Items.build([(7, " ".join(item)), (8, None), (9, "two words")])
    items.choose(np.ones(len(items.vocabulary)))
    texts = pa.array([None, "", "a b " + " ".join(item) + " c", " ".join(item[:3])])
    assert list(decontaminate.matches(texts, items)) == [(2, 0, 1.0, 2, 21)]


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(decontaminate.contaminated(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 15)
    assert sorted(decontaminate.contaminated(docs, items).collect()) == want


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "the quick brown fox jumps over the lazy dog"), (3, "the quick brown fox jumps over the lazy dog"), (None, "a text without identifier")], "item_id long, text string")
    found = decontaminate.contaminated(odd, items).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == sorted([(1, 3)] * 4 + [(None, None)], key=str)
    assert decontaminate.contaminated(nothing, items).collect() == []
    assert decontaminate.contaminated(odd, items.where("false")).collect() == []
    assert decontaminate.keep_clean(odd, items.where("false")).count() == odd.count()
