import random
import re

import numpy as np
import xxhash

from emberlog.llm import fingerprints, near_dedup
from emberlog.llm.hamming import components, inside, masks

from odd_rows import LONG, SF


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius):
    label = dict(enumerate(ids))
    near = [np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= radius).tolist() for i in range(len(fps))]
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            low = min((label[j] for j in others if label[j] is not None), default=None)
            if low != label[i]:
                label[i], changed = low, True
    return [label[i] for i in range(len(ids))]


def some(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    flipped = base.repeat(4)
    for _ in range(3):
        flipped ^= np.uint64(1) << rng.integers(0, 64, len(flipped)).astype(np.uint64)
    chain = [base[0]]
    for _ in range(300):
        chain.append(chain[-1] ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))))
    return np.unique(np.concatenate([base, flipped, np.array(chain, np.uint64)]))


def test_bit_planes_give_the_number_of_differing_bits():
    fps = some()
    for radius in (0, 1, 3, 4, 7, 8, 20):
        assert (near_dedup.near(fps[:90], fps, radius) == (np.bitwise_count(fps[:90, None] ^ fps) <= radius)).all()
        assert (fingerprints.near(fps[:90], fps, radius) == (np.bitwise_count(fps[:90, None] ^ fps) <= radius)).all()


def test_components_inside_a_bucket():
    fps = some(2)
    a, b = inside(fps, 4, near_dedup.near)
    top = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert [top.get(int(x), int(x)) for x in fps] == [int(fps[i]) for i in plain_components(range(len(fps)), fps, 4)]


def test_tables_find_every_pair():
    rng = random.Random(3)
    for rows in (10, 10**8, 10**11, 10**15):
        for radius in (3, 4):
            for _ in range(300):
                difference = sum(1 << i for i in rng.sample(range(64), radius))
                assert any(not difference & m for m in masks(radius, rows))


def test_stars(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)] + [(7, 7)]
    low = {i: i for e in edges for i in e}
    for _ in range(100):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {i: got.get(i, i) for i in low} == low
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = {r.doc_id: r for r in near_dedup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    fps = np.array([plain_fingerprint(d.text) for d in docs], np.uint64)
    assert [rows[d.doc_id].fingerprint for d in docs] == [f"{int(f):016x}" for f in fps]
    assert [rows[d.doc_id].component_id for d in docs] == plain_components([d.doc_id for d in docs], fps, 4)


def test_odd_rows(spark, odd, nothing):
    rows = near_dedup.near_duplicates(odd).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        assert f"{plain_fingerprint(text):016x}" in {r.fingerprint for r in rows if r.doc_id == doc_id}
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2}
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    kept = [r.doc_id for r in near_dedup.keep_one(odd).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 5, 6, None, 8, 9], key=str)
    assert near_dedup.near_duplicates(nothing).collect() == []


def test_a_long_text_is_hashed_in_pieces(monkeypatch):
    whole = near_dedup.simhash(LONG.encode())
    monkeypatch.setattr(near_dedup, "pieces", lambda t: [t[:100_000].rsplit(b" ", 1)[0], t[len(t[:100_000].rsplit(b" ", 1)[0]) :]])
    assert near_dedup.simhash(LONG.encode()) == whole


def test_large_buckets_are_cut(spark, monkeypatch):
    from emberlog.llm import hamming

    rng = np.random.default_rng(5)
    near = np.uint64(1234) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    fps = np.unique(np.concatenate([near, some(6)]))
    monkeypatch.setattr(hamming, "max", lambda *a: 64, raising=False)  # chunks of 64 rows
    rows = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps.astype(np.int64))], "doc_id long, fp long")
    found = sorted((r.doc_id, r.component_id) for r in hamming.classes(rows, 4, near_dedup.near).collect())
    assert [c for _, c in found] == plain_components(range(len(fps)), fps, 4)


def test_one_row_of_each_component_stays(spark):
    """Also where no row has an identifier, or the identifier repeats with another text."""
    base = " ".join(f"word{i}" for i in range(400))
    other = " ".join(f"other{i}" for i in range(400))
    near_base, near_other = base + " more", other + " more"
    rows = [(None, base), (None, near_base), (None, base), (4, other), (4, near_other), (7, other), (9, "alone"), (None, "all by itself")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = near_dedup.near_duplicates(docs).collect()
    assert len({r.fingerprint for r in links}) >= 4
    kept = [(r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect()]
    assert len(kept) == 4 and sum(i is None for i, _ in kept) == 2 and sum(i == 4 for i, _ in kept) == 1 and (9, "alone") in kept
    assert sum(t in (base, near_base) for _, t in kept) == 1
