"""Piece tables against plain string work by the definition."""

import hashlib
import random
import re

import pytest

from emberlog.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plainly(doc_id, text):
    text = text or ""
    tokens = UNIT.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_against_strings(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    draw = random.Random(7)
    kinds = set()
    for doc_id in range(400):
        text = "".join(draw.choice(["ab", "Zz", " ", "é", "东", "\U0001f600", "<", ">", "<P", "S>", "\n", "M", "9"]) for _ in range(draw.randrange(12)))
        n, form, prefix, middle, output = plainly(doc_id, text)
        kinds.add(form)
        found_n, found_form, parts, table = fim.transformed(doc_id, text.encode())
        assert (found_n, found_form, table.joined().decode(), table.digest()) == (n, form, output, sha(output))
        if form != "plain":
            assert (parts.only(0).chars(), parts.only(1).chars()) == (prefix, middle)
        assert fim.restored(output.encode(), form).joined().decode() == text
    assert kinds == {"plain", "psm", "spm"}


def test_cuts_split_descriptors_and_copy_nothing():
    table = fim.cut(fim.cut(fim.whole(b"abcdef"), 2), 2)
    assert table.pieces == ((0, 0, 2), (0, 2, 2), (0, 2, 6))
    assert table.buffers[0] is fim.arranged(table, "psm").buffers[0]
    assert fim.cut(table, 6).pieces[-2:] == ((0, 2, 6), (0, 6, 6))


def test_on_odd_rows(spark, odd, nothing):
    rows = sorted(map(tuple, fim.digests(odd).collect()), key=repr)
    want = []
    for row in odd.collect():
        n, form, prefix, middle, output = plainly(row.doc_id, row.text)
        want.append((row.doc_id, n, form, prefix, middle, sha(output), sha(row.text or "")))
    assert rows == sorted(want, key=repr)
    assert fim.digests(nothing).collect() == []


def test_there_and_back(spark, odd):
    back = fim.restore(fim.transform(odd)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())


def test_long_text_takes_little_memory():
    import tracemalloc

    text = ("word é! " * 1_500_000).encode()
    tracemalloc.start()
    n, _, _, table = fim.transformed(4, text)
    table.digest()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 5 * 1_500_000 and peak < 2.5 * len(text)
