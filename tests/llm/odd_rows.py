"""Rows that operators have to bear: nulls, blanks, long texts, repeated rows, clashing names."""

SF = "/root/testdata/sf0.001"

#: Columns of ``documents``, and one of each name that operators use for themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, row string, words string, _key string, digest string, `odd name` int"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))


def document(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, 8, "r", "w", "k", "d", 9)


ODD = [
    document(1, "the quick brown fox jumps over the lazy dog\nsecond line of it"),
    document(1, "the quick brown fox jumps over the lazy dog\nsecond line of it"),
    document(2, None),
    document(3, ""),
    document(4, " \t\n\n "),
    document(5, "word"),
    document(6, LONG, None, None),
    document(7, LONG + " end", "en", "b"),
    document(None, "a text without identifier", None, None),
    document(8, "ÄÖÜ ß é 东西 \U0001f600 \x0b x\x00y", "de", "b"),
    document(9, "!!! 123 ???", "en", "c"),
]


