import hashlib

import numpy as np

from emberlog.llm import fingerprints

from odd_rows import SF


def check(docs, rows):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    texts = [t or "" for _, t in order]
    found = {}
    for r in rows:
        found.setdefault((r.doc_id, r.n_chars), []).append(r)
    for i, (doc_id, _) in enumerate(order):
        text, following = texts[i], texts[(i + 1) % len(texts)]
        part = len(text) // 3
        edited = text[: len(text) - part] + following[:part]
        assert hashlib.sha256(edited.encode()).hexdigest() in {r.edited_sha256 for r in found[doc_id, len(text)]}
    assert len(rows) == len(docs)


def test_neighbours_and_edited_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = fingerprints.fingerprinted(docs).collect()
    told = [tuple(d) for d in docs.collect()]
    check(told, rows)
    by_text = {}
    prints = {r.doc_id: r for r in rows}
    for doc_id, text in told:
        assert by_text.setdefault(text, prints[doc_id].fingerprint) == prints[doc_id].fingerprint
    long = [r for r in rows if r.n_chars > 2000]
    assert np.mean([r.near_edited for r in long]) > 0.5 > np.mean([r.near_next for r in long]) + 0.2
    for r in rows:
        a, b = (np.array([int(x, 16)], np.uint64) for x in (r.fingerprint, r.edited_fingerprint))
        assert abs(fingerprints.likeness(a, b)[0] - r.near_edited) < 1e-12


def test_classes(spark):
    words = [f"w{i}" for i in range(400)]
    changed = words.copy()
    changed[200] = "other"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(changed)), (4, " ".join(reversed(words)))], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in fingerprints.fingerprinted(docs, radius=8).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_odd_rows(spark, odd, nothing):
    rows = fingerprints.fingerprinted(odd).collect()
    check([(r.doc_id, r.text) for r in odd.collect()], rows)
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {"0" * 16}
    assert fingerprints.fingerprinted(nothing).collect() == []
    one = fingerprints.fingerprinted(odd.where("doc_id = 5")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(4, 1.0)]
