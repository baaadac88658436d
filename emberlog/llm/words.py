"""Hashed words of whole Arrow columns, by array operations over the bytes of many texts at once.

A word is a run of ASCII letters and digits and of bytes above 0x7F. A to Z and the capitals of Latin-1 (in UTF-8 0xC3
and a byte from 0x80 to 0x9E) count as their small letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from emberlog.llm.common import buffers

#: Bytes of texts that are hashed at once. A longer text is cut at a byte that belongs to no word.
AT_ONCE = 1 << 20
BASE = 0x9E3779B97F4A7C15
#: The inverse of ``BASE`` modulo 2^64.
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and ``INVERSE ** i`` for i below ``size`` or more."""
    if not _powers or max(_powers) < size:
        room = max(AT_ONCE + 1, size)
        tables = []
        for base in (BASE, INVERSE):
            factors = np.full(room, base, np.uint64)
            factors[0] = 1
            tables.append(np.multiply.accumulate(factors))
        _powers.clear()
        _powers[room] = tuple(tables)
    return next(iter(_powers.values()))


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of ``h`` spread over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of the rows from ``row`` on: those of row ``row + i`` are ``first[i]`` to ``first[i + 1]``."""

    row: int
    first: np.ndarray
    hashes: np.ndarray
    #: For each asked number of bytes: hashes of the words' beginnings of at most so many bytes.
    heads: list[np.ndarray]

    def texts(self) -> Iterator[tuple[int, slice]]:
        ends = self.first.tolist()
        for i in range(len(ends) - 1):
            yield self.row + i, slice(ends[i], ends[i + 1])


def hashed(data: np.ndarray, starts: np.ndarray, heads: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First word of each text, hashes of the words and of their beginnings. ``starts`` has the end as well."""
    size = len(data)
    low = LOWER[data]
    if size > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][second] += 0x20
    word = IN_WORD[low]
    before = np.empty(size, bool)
    before[:1] = False
    before[1:] = word[:-1]
    inner = starts[:-1][starts[:-1] < size]
    before[inner] = False
    begin = np.flatnonzero(word & ~before)
    after = np.empty(size, bool)
    after[size - 1 :] = False
    after[:-1] = word[1:]
    after[inner[inner > 0] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    up, down = powers(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
    back = down[begin]
    whole = mixed((sums[end] - sums[begin]) * back)
    parts = [mixed((sums[np.minimum(end, begin + n)] - sums[begin]) * back) for n in heads]
    return np.searchsorted(begin, starts), whole, parts


def cuts(data: np.ndarray) -> list[int]:
    """Where a long text is cut: about every ``AT_ONCE`` bytes, at a byte that belongs to no word."""
    places, at = [0], 0
    while len(data) - at > AT_ONCE:
        at += AT_ONCE
        while at < len(data):
            gap = np.flatnonzero(~IN_WORD[LOWER[data[at : at + AT_ONCE]]])
            if len(gap):
                at += int(gap[0])
                break
            at = min(len(data), at + AT_ONCE)
        if at < len(data):
            places.append(at)
    return [*places, len(data)]


def words(column: pa.Array, heads: tuple[int, ...] = ()) -> Iterator[Words]:
    """Words of all texts of ``column`` in order, some texts at a time. Null has none."""
    data, starts = buffers(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(starts, starts[row] + AT_ONCE, "right")) - 1)
        part = data[starts[row] : starts[stop]]
        if stop == row + 1 and len(part) > AT_ONCE:
            places = cuts(part)
            found = [hashed(part[a:b], np.array([0, b - a]), heads) for a, b in zip(places, places[1:], strict=False)]
            hashes = np.concatenate([f[1] for f in found])
            yield Words(row, np.array([0, len(hashes)]), hashes, [np.concatenate([f[2][i] for f in found]) for i in range(len(heads))])
        else:
            first, hashes, parts = hashed(part, starts[row : stop + 1] - starts[row], heads)
            yield Words(row, first, hashes, parts)
        row = stop


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each ``width`` consecutive words; none if there are fewer."""
    if len(hashes) < width:
        return hashes[:0]
    out = hashes[: len(hashes) - width + 1].copy()
    for i in range(1, width):
        out = out * np.uint64(BASE) + hashes[i : len(hashes) - width + 1 + i]
    return mixed(out)
