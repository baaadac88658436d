"""Fill-in-the-middle transformation with piece tables.

A document is a piece table: descriptors ``(buffer, begin, end)`` over two immutable buffers, its text and the
sentinels. At first it is one descriptor. A cut splits a descriptor in two, an arrangement permutes descriptors and
puts sentinels between them, and nothing is copied until a reader streams the pieces, into a digest or a new text.

The way back makes a piece table over the output: sentinels are found, what stands between them are the pieces, and
the inverse permutation gives the text. Texts with a sentinel of their own stay plain, so this is exact.

Units are runs of ASCII letters, and every other character. They are counted and found in blocks of bytes, so besides
the text itself a long document needs little memory.

Defined cases: a null text counts as empty; an empty text is plain with no units; a null identifier counts as an empty
one in the draws; rows that repeat give equal rows; an empty table gives none. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import small, texts

#: Shares in hundredths: documents that stay plain are those from KEEP on; suffix first are those below SPM.
KEEP, SPM = 90, 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
BLOCK = 1 << 20

TEXT, MARKS = 0, 1
Piece = tuple[int, int, int]
P, S, M = ((MARKS, i, i + 3) for i in (0, 3, 6))
#: Order of the parts (0 prefix, 1 middle, 2 suffix), each after its sentinel.
FORMS = {"psm": ((P, 0), (S, 2), (M, 1)), "spm": ((S, 2), (P, 0), (M, 1))}

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: Bytes that continue a character in UTF-8.
INNER = np.zeros(256, bool)
INNER[0x80:0xC0] = True


@dataclass(frozen=True)
class Table:
    """Descriptors over the buffers; a view for its readers, never a copy of them."""

    buffers: tuple[bytes, bytes]
    pieces: tuple[Piece, ...]

    def stream(self) -> Iterator[memoryview]:
        views = [memoryview(b) for b in self.buffers]
        for buffer, begin, end in self.pieces:
            for at in range(begin, end, BLOCK):
                yield views[buffer][at : min(end, at + BLOCK)]

    def digest(self) -> str:
        found = hashlib.sha256()
        for part in self.stream():
            found.update(part)
        return found.hexdigest()

    def joined(self) -> bytes:
        return b"".join(self.stream())

    def chars(self) -> int:
        return sum(int((~INNER[np.frombuffer(part, np.uint8)]).sum()) for part in self.stream())

    def only(self, *numbers: int) -> Table:
        return Table(self.buffers, tuple(self.pieces[i] for i in numbers))


def whole(text: bytes) -> Table:
    return Table((text, SENTINELS), ((TEXT, 0, len(text)),))


def cut(table: Table, at: int) -> Table:
    """The last descriptor that begins at or before place ``at`` of what the table reads, split there."""
    begins = [0, *accumulate(end - begin for _, begin, end in table.pieces[:-1])]
    i = bisect_right(begins, at) - 1
    buffer, begin, end = table.pieces[i]
    here = begin + at - begins[i]
    return Table(table.buffers, (*table.pieces[:i], (buffer, begin, here), (buffer, here, end), *table.pieces[i + 1 :]))


def arranged(table: Table, form: str) -> Table:
    """A table of three pieces in the order of ``form``, with sentinels."""
    return Table(table.buffers, tuple(piece for mark, part in FORMS[form] for piece in (mark, table.pieces[part])))


def restored(output: bytes, form: str) -> Table:
    """The text that ``output`` was made from, as a table over it."""
    if form == "plain":
        return whole(output)
    parts, at, places = {}, 0, []
    for mark, part in FORMS[form]:
        place = output.index(SENTINELS[mark[1] : mark[2]], at)
        places.append((part, place, at := place + 3))
    for i, (part, _, begin) in enumerate(places):
        parts[part] = (TEXT, begin, places[i + 1][1] if i + 1 < len(places) else len(output))
    return Table((output, SENTINELS), tuple(parts[i] for i in range(3)))


def starts(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Where units begin, block by block: the block's place, and the places in it."""
    data, letter_before = np.frombuffer(text, np.uint8), False
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        letter = LETTER[part]
        before = np.empty_like(letter)
        before[0], before[1:] = letter_before, letter[:-1]
        letter_before = bool(letter[-1])
        yield at, np.flatnonzero((letter & ~before) | ~(letter | INNER[part]))


def units(text: bytes) -> int:
    return sum(len(found) for _, found in starts(text))


def ends(text: bytes, counts: list[int]) -> list[int]:
    """Bytes that the first ``counts`` units take, for each of them; counts ascend."""
    places, passed = [], 0
    for at, found in starts(text):
        while len(places) < len(counts) and counts[len(places)] < passed + len(found):
            places.append(at + int(found[counts[len(places)] - passed]))
        passed += len(found)
    return places + [len(text)] * (len(counts) - len(places))


def draws(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transformed(doc_id: int | None, text: bytes, keep: int = KEEP, spm: int = SPM) -> tuple[int, str, Table, Table]:
    """Number of units, form, the table of the three parts (of the whole text if plain) and the table of the output."""
    n, h = units(text), draws(doc_id)
    table = whole(text)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= keep:
        return n, "plain", table, table
    low, high = ends(text, sorted((h[0] % (n + 1), h[1] % (n + 1))))
    parts = cut(cut(table, low), high)
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, parts, arranged(parts, form)


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def digests(docs: DataFrame, keep: int = KEEP, spm: int = SPM) -> DataFrame:
    """A row for each row of ``docs``: see ``SCHEMA``. The restored text is rebuilt from the output and the form."""

    def row(doc_id: int | None, text: bytes) -> tuple:
        n, form, parts, output = transformed(doc_id, text, keep, spm)
        plain = form == "plain"
        back = restored(text if plain else output.joined(), form)
        chars = (None, None) if plain else (parts.only(0).chars(), parts.only(1).chars())
        return (doc_id, n, form, *chars, output.digest(), back.digest())

    return mapped(docs, row, SCHEMA)


def transform(docs: DataFrame, keep: int = KEEP, spm: int = SPM) -> DataFrame:
    """``doc_id``, ``form`` and the transformed text as ``output``."""

    def row(doc_id: int | None, text: bytes) -> tuple:
        _, form, _, output = transformed(doc_id, text, keep, spm)
        return doc_id, form, (text if form == "plain" else output.joined()).decode("utf-8", "replace")

    return mapped(docs, row, "doc_id long, form string, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of what ``transform`` gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            back = [restored(t, f).joined().decode("utf-8", "replace") for t, f in zip(texts(batch.column(2)), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], ["doc_id", "text"])

    return outputs.select("doc_id", "form", "output").mapInArrow(run, "doc_id long, text string")


def mapped(docs: DataFrame, row, schema: str) -> DataFrame:
    names = [field.split()[0] for field in schema.split(", ")]
    types = [pa.int64() if field.endswith("long") else pa.string() for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [row(i, t) for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


#: The same in DuckDB.
SQL = """
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as digest from documents),
h as (
  select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units,
    list_transform(range(4), lambda i: cast('0x' || substr(digest, cast(1 + 8 * i as bigint), 8) as bigint)) as h from t),
c as (
  select *, len(units) as n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as low, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as high,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain'
      when h[4] % 100 < 20 then 'spm' else 'psm' end as form
  from h),
p as (
  select doc_id, text, n, form, array_to_string(units[1:low], '') as prefix, array_to_string(units[low + 1:high], '') as middle,
    array_to_string(units[high + 1:], '') as suffix from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then text else prefix || middle || suffix end) as restored_sha256
from p"""
