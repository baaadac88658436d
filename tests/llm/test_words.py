import re

import pyarrow as pa

from emberlog.llm import words


def plain(text):
    low = "".join(c.lower() if ord(c) < 128 or (0xC0 <= ord(c) <= 0xDE and ord(c) != 0xD7) else c for c in text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)


def hashes(texts, heads=()):
    return [(part.row + i, part.hashes[at].tolist(), [h[at].tolist() for h in part.heads]) for part in words.words(pa.array(texts, pa.string()), heads) for i, (_, at) in enumerate(part.texts())]


def test_equal_words_have_equal_hashes():
    texts = ["Ab é ÉÀ×x12, foo_bar", None, "", "x" * 50, "a b c", "ÀÉ é", "ab", "foo bar Foo", "东西 a\x00b"]
    seen = {}
    for row, own, (heads,) in hashes(texts, (2,)):
        assert len(own) == len(plain(texts[row]))
        for word, h, head in zip(plain(texts[row]), own, heads, strict=True):
            assert seen.setdefault(word, h) == h
            assert seen.setdefault(word.encode()[:2], head) == head
    whole = [v for k, v in seen.items() if isinstance(k, str)]
    assert len(set(whole)) == len(whole)


def test_long_texts_are_cut_between_words(monkeypatch):
    texts = [" ".join(f"w{i * j}" for i in range(j)) for j in range(1, 60)] + ["y" * 300 + " z"]
    want = hashes(texts)
    monkeypatch.setattr(words, "AT_ONCE", 64)
    words._powers.clear()
    assert hashes(texts) == want
    words._powers.clear()
