"""SimHash near-duplicate documents, compared by bit planes.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it. Documents whose
fingerprints differ in at most ``radius`` bits are linked, and each gets the smallest identifier that it reaches.

Within a bucket of :mod:`emberlog.llm.hamming` the fingerprints are stored vertically: plane ``i`` holds bit ``i`` of
64 fingerprints in a word. XOR with a pivot's bit gives 64 differing bits at once, three planes are added by a
carry-save adder into bit-sliced counters, and a pivot is abandoned once all of its lanes exceed the radius.

Defined cases: a null or blank text has the fingerprint zero and is linked like any other; a text with fewer words
than a shingle is one shingle; rows that repeat give equal rows; an empty table gives none. Only ``doc_id`` and
``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from emberlog.llm.common import cut, pieces, small, texts
from emberlog.llm.hamming import classes

SHINGLE, RADIUS, SEED = 4, 4, 42
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, in parts. White space is 0x20 and 0x09 to 0x0D, and A to Z count as a to z."""
    held: list[bytes] = []
    found = False
    for piece in pieces(text):
        words = held + piece.lower().split()
        if len(words) >= width:
            joined = b" ".join(words)
            ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
            starts = [0, *(e + 1 for e in ends[: len(words) - width])]
            yield np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)], np.uint64)
            found = True
            held = words[len(words) - width + 1 :] if width > 1 else []
        else:
            held = words
    if held and not found:
        yield np.array([xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def simhash(text: bytes, width: int = SHINGLE) -> int:
    """Fingerprint of ``text`` as an unsigned number."""
    votes, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        for start in range(0, len(hashes), 1 << 14):
            part = hashes[start : start + (1 << 14)]
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.uint64)[0])


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows, of which row ``i`` has bit ``i`` of all fingerprints, 64 in a word."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.zeros((lanes, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def above(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is larger than ``radius``."""
    larger, equal = over.copy(), ~over
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            larger |= equal & counters[i]
            equal &= ~counters[i]
    return larger


def near(pivots: np.ndarray, others: np.ndarray, radius: int) -> np.ndarray:
    """Matrix of the pairs that differ in at most ``radius`` bits."""
    others = np.ascontiguousarray(others)
    rows = planes(others)
    out = np.zeros((len(pivots), len(others)), bool)
    alive = np.arange(len(pivots))
    flips = (np.unpackbits(np.ascontiguousarray(pivots).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.uint64) * ONES)[:, :, None]
    counters = [np.zeros((len(pivots), rows.shape[1]), np.uint64) for _ in range(radius.bit_length() or 1)]
    over = np.zeros_like(counters[0])
    for step, i in enumerate(range(0, 64, 3)):
        x = rows[i] ^ flips[:, i]
        if i + 2 < 64:
            y, z = rows[i + 1] ^ flips[:, i + 1], rows[i + 2] ^ flips[:, i + 2]
            half = x ^ y
            ones, twos = half ^ z, (x & y) | (half & z)
        else:
            ones, twos = x, None
        carry = counters[0] & ones
        counters[0] ^= ones
        for k in range(1, len(counters)):
            if twos is None:
                carry, counters[k] = counters[k] & carry, counters[k] ^ carry
            else:
                half = counters[k] ^ carry
                carry, counters[k] = (counters[k] & carry) | (half & twos), half ^ twos
                twos = None
        over |= carry
        if twos is not None:
            over |= twos
        if step % 4 == 3 or i + 3 >= 64:
            beyond = above(counters, over, radius)
            keep = ~(beyond == ONES).all(axis=1)
            if not keep.all():
                alive, flips, over, beyond = alive[keep], flips[keep], over[keep], beyond[keep]
                counters = [c[keep] for c in counters]
                if not len(alive):
                    return out
    lanes = np.unpackbits(beyond.view(np.uint8), axis=1, bitorder="little")[:, : len(others)]
    out[alive] = lanes == 0
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE, *also: str) -> DataFrame:
    """``doc_id``, columns ``also`` (longs) and ``fp`` (the fingerprint's bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            values = np.array([simhash(t, width) for t in texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(values.view(np.int64))], ["doc_id", *also, "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *also)
    return rows.mapInArrow(run, ", ".join(f"{name} long" for name in ("doc_id", *also, "fp")))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row of ``docs``."""
    found = classes(cut(fingerprints(docs, width)), radius, near)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` of each component, whole: that of the smallest identifier.

    Rows are told apart by identifier and text: of different texts under the smallest identifier, or without any in the
    whole component, the one with the smallest hash stays, and of equal rows one.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    found = classes(cut(fingerprints(rows, width, "digest")), radius, near)
    whose = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    first = found.groupBy("top").agg(F.min(whose).alias("first"))
    stay = cut(first.select(F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias("_key"), F.col("first.digest").alias("_digest")).distinct())
    held = docs.select(
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("_key"), F.xxhash64("text").alias("_digest"), F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_row")
    )
    one = Window.partitionBy("_key", "_digest").orderBy(F.lit(0))
    return held.join(stay, ["_key", "_digest"], "left_semi").withColumn("_no", F.row_number().over(one)).where("_no = 1").select("_row.*")
