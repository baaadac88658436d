import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from emberlog.llm import warc

LINE = "WARC/1.1\r\n"
PAGES = [
    (1, "u", None), (2, None, ""), (3, "a\r\nb", "x\r\n\r\ny" + LINE + "é" * 50 + LINE + LINE), (4, "é", "ü" * 1000),
    (5, "é", "ü" * 1000), (6, "z", LINE), (7, "", "WARC/1."), (8, "q", LINE * 5 + "a"), (None, "n", "ü" * 1000),
    (5, "é", "ü" * 1000), (9, "w", "\r\n\r\n"), (10, "k", "1\r\n"), (11, "long", "abc\x00" * 300_000), (None, None, "alone"),
]


def plain(pages, least=0):
    rows = []
    for page_id, _, html in pages:
        body = (html or "").encode()
        same = [i for i, _, other in pages if (other or "") == (html or "") and i is not None] if len(body) >= least else []
        first = min(same, default=None)
        kind = "response" if page_id == first or first is None else "revisit"
        rows.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, None if kind == "response" else first))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("chunk", [7, 64, 1 << 18])
def test_round_trip(spark, chunk):
    pages = PAGES if chunk > 7 else PAGES[:10]
    rows = warc.round_trip(spark.createDataFrame(pages, warc.PAGES), chunk).collect()
    assert sorted(map(tuple, rows), key=repr) == plain(pages)


def test_small_payloads_are_not_compared(spark):
    rows = warc.round_trip(spark.createDataFrame(PAGES, warc.PAGES), least=5000).collect()
    assert sorted(map(tuple, rows), key=repr) == plain(PAGES, 5000)


def test_no_chunk_is_larger_than_asked(spark):
    table = warc.chunks(warc.typed(spark.createDataFrame(PAGES, warc.PAGES)), 100).collect()
    assert max(len(r.data) for r in table) == 100
    assert not any(LINE.encode() in r.data for r in table)
    by_record = {}
    for r in sorted(table, key=lambda r: r.chunk_no):
        by_record[r.record_id] = by_record.get(r.record_id, b"") + bytes(r.data)
    whole = sorted(by_record.values())
    assert b"abc\x00" * 300_000 in whole and len(by_record) == len(PAGES)


def test_archives_are_warc(spark, tmp_path):
    """Read by a parser that knows of lengths only."""
    warc.write(spark.createDataFrame(PAGES, warc.PAGES), str(tmp_path / "out"), 5000)
    kinds = []
    for path in Path(tmp_path / "out").glob("part-*"):
        data = gzip.decompress(path.read_bytes())
        while data:
            header, _, rest = data.partition(b"\r\n\r\n")
            version, *fields = header.decode().split("\r\n")
            fields = dict(f.split(": ", 1) for f in fields)
            length = int(fields["Content-Length"])
            assert version == "WARC/1.1" and rest[length : length + 4] == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"])
            data = rest[length + 4 :]
    assert kinds.count("response") + kinds.count("revisit") == len(PAGES) and kinds.count("continuation") > 200


def test_damage_is_noticed(spark, tmp_path):
    warc.write(spark.createDataFrame(PAGES[3:4], warc.PAGES), str(tmp_path / "out"))
    (path,) = [p for p in Path(tmp_path / "out").glob("part-*") if gzip.decompress(p.read_bytes())]
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace("üü".encode(), "üa".encode(), 1)))
    for crc in Path(tmp_path / "out").glob(".*crc"):
        crc.unlink()
    with pytest.raises(Exception, match="damaged|differs"):
        warc.records(warc.read(spark, str(tmp_path / "out"))).collect()


def test_extra_columns_and_empty_table(spark):
    wide = spark.createDataFrame([(*p, 1, "b", "d") for p in PAGES], warc.PAGES + ", bytes int, body string, digest string")
    assert sorted(map(tuple, warc.round_trip(wide).collect()), key=repr) == plain(PAGES)
    assert warc.round_trip(spark.createDataFrame([], warc.PAGES)).collect() == []


def test_version_lines_are_cut_in_linear_time(spark):
    import time

    pages = [(1, "dump", (LINE + "x") * 100_000), (2, "u", "plain")]
    start = time.time()
    rows = warc.round_trip(spark.createDataFrame(pages, warc.PAGES)).collect()
    assert sorted(map(tuple, rows), key=repr) == plain(pages)
    assert time.time() - start < 90
