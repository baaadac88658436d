"""Passages of benchmark items in documents, also edited or paraphrased ones.

A first pass over all documents counts the items' words. An item's seeds are those of its n-grams that are rarest by
chance, that is by the product of their words' frequencies. The n-grams' own counts would be misleading: copies raise
them, and an edited copy would then be left with the frequent ones. A second pass joins the places of seeds in a document to the items that have them. Seeds on about the same
diagonal give a window, and Smith-Waterman alignment of the item with the window's words gives the score: a local
alignment with ``MATCH``, ``MISMATCH`` and ``GAP``, as a share of what the whole item would have.

The texts stay where they are read; only counts are shuffled. Items are the stated query set: they go to the tasks
in blocks of bounded size (``BLOCK_ITEMS``, ``BLOCK_CHARS``), and each block is a run over all documents.

Defined cases: a null or blank text or item, or an item of fewer than ``WIDTH`` words, matches nothing; rows that
repeat are rows of their own, items that repeat are reported each; empty tables give none. From the tables only
``doc_id``, ``item_id`` and ``text`` are read; :func:`keep_clean` gives whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import small
from emberlog.llm.words import Words, shingles, words

WIDTH = 3
#: Share of an item's n-grams that are seeds, the rarest ones, and how many at least.
RARE, LEAST = 0.75, 12
MATCH, MISMATCH, GAP = 2, -1, -1
#: Score from which a document counts as contaminated.
THRESHOLD = 0.5
#: Items and characters of items that go to the tasks at once.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
#: Bits of the table that tells quickly that an n-gram is of no item.
SIEVE = 22
MATCHES = "doc_id long, item_id long, score double, first_word long, last_word long"


@dataclass
class Items:
    ids: list[int | None]
    words: list[np.ndarray]
    #: All n-grams, sorted; the places of n-gram ``i`` are ``of[at[i]:at[i + 1]]`` (item) and ``place`` (word) likewise.
    grams: np.ndarray
    at: np.ndarray
    of: np.ndarray
    place: np.ndarray
    sieve: np.ndarray
    seed: np.ndarray
    #: All words, sorted, and a sieve for them.
    vocabulary: np.ndarray
    word_sieve: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int | None, str | None]], width: int = WIDTH) -> Items:
        column = pa.array([t for _, t in rows], pa.large_string())
        told = [part.hashes[at] for part in words(column) for _, at in part.texts()]
        grams = [shingles(w, width) for w in told]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        unique, at = np.unique(every[order], return_index=True)
        vocabulary = np.unique(np.concatenate([*told, np.zeros(0, np.uint64)]))
        return cls(
            [i for i, _ in rows], told, unique, np.r_[at, len(every)], of[order], place[order], sieve(unique), np.zeros(len(unique), bool), vocabulary, sieve(vocabulary)
        )

    def choose(self, occurrences: np.ndarray, width: int = WIDTH) -> None:
        """Seeds from the number of occurrences of each word of the vocabulary."""
        rarity = np.log(np.maximum(occurrences, 0.5))
        for told in self.words:
            if len(grams := shingles(told, width)):
                each = rarity[np.searchsorted(self.vocabulary, told)]
                chance = sum(each[i : len(each) - width + 1 + i] for i in range(width))
                number = max(LEAST, int(np.ceil(RARE * len(grams))))
                self.seed[np.searchsorted(self.grams, grams[np.argsort(chance, kind="stable")[:number]])] = True

    def hits(self, part: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text (within ``part``), word and number of the n-gram of all places in ``part`` that have an n-gram of an item."""
        grams = shingles(part.hashes, width)
        where = np.flatnonzero(self.sieve[grams >> np.uint64(64 - SIEVE)])
        number = np.searchsorted(self.grams, grams[where])
        right = number < len(self.grams)
        right[right] = self.grams[number[right]] == grams[where[right]]
        where, number = where[right], number[right]
        text = np.searchsorted(part.first, where, "right") - 1
        inside = where + width <= part.first[text + 1]
        return text[inside], where[inside], number[inside]


def sieve(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << SIEVE, bool)
    out[hashes >> np.uint64(64 - SIEVE)] = True
    return out


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items, in blocks that are small enough for the driver and each task."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    number = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(number))
    for k in range(number):
        items = Items.build(sorted(map(tuple, rows.where(block == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))
        if len(items.grams):
            yield items


def occurrences(docs: DataFrame, items: Items) -> np.ndarray:
    """Number of occurrences of each word of the block in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        total = np.zeros(len(block.vocabulary), np.int64)
        for batch in small(batches):
            for part in words(batch.column(0)):
                some = part.hashes[block.word_sieve[part.hashes >> np.uint64(64 - SIEVE)]]
                number = np.minimum(np.searchsorted(block.vocabulary, some), len(total) - 1)
                total += np.bincount(number[block.vocabulary[number] == some], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["word", "n"])

    # a row for each word of the block
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(items.vocabulary), np.int64)
    counts[found["word"].to_numpy(np.int64)] = found["n"].to_numpy()
    return counts


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Score of the best local alignment, and the place in ``window`` where it ends."""
    ramp = -GAP * np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        step = np.maximum(row + GAP, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(window == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(step + ramp) - ramp
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def matches(column: pa.Array, items: Items, threshold: float = THRESHOLD, known: dict | None = None) -> Iterator[tuple[int, int, float, int, int]]:
    """Row, item, score, first and last word of the best alignment of each text and item that reaches the threshold."""
    known = {} if known is None else known
    for part in words(column):
        text, where, number = items.hits(part)
        seed = items.seed[number]
        text, where, number = text[seed], where[seed], number[seed]
        if not len(text):
            continue
        often = items.at[number + 1] - items.at[number]
        index = np.repeat(items.at[number] - np.r_[0, np.cumsum(often)[:-1]], often) + np.arange(int(often.sum()))
        text, where = np.repeat(text, often), np.repeat(where, often)
        item, begin = items.of[index], where - items.place[index]
        order = np.lexsort((begin, item, text))
        text, item, begin = text[order], item[order], begin[order]
        # seeds of one text and item belong together while their diagonals are less than the item apart
        sizes = np.array([len(w) for w in items.words], np.int64)
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > sizes[item[1:]])
        at = np.flatnonzero(new)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(text)], strict=True):
            t, k = int(text[a]), int(item[a])
            wanted = items.words[k]
            slack = 3 + len(wanted) // 4
            low = max(int(part.first[t]), int(begin[a]) - slack)
            high = min(int(part.first[t + 1]), int(begin[b - 1]) + len(wanted) + slack)
            window = part.hashes[low:high]
            if np.isin(window, wanted).sum() < threshold * len(wanted):
                continue  # too few of the item's words for the score
            key = (k, window.tobytes()) if len(window) < 4096 else None
            if key is None or key not in known:
                score, end = align(wanted, window)
                back = align(wanted[::-1], window[:end][::-1])[1] if score >= threshold * MATCH * len(wanted) else 0
                if len(known) > 20_000:
                    known.clear()
                found = (score / (MATCH * len(wanted)), end - back, end - 1)
                if key is not None:
                    known[key] = found
            else:
                found = known[key]
            if found[0] >= threshold:
                first = low - int(part.first[t])
                best[t, k] = max(best.get((t, k), (0.0, 0, 0)), (found[0], first + found[1], first + found[2]))
        for (t, k), (score, first, last) in best.items():
            yield part.row + t, k, score, first, last


def seeded(docs: DataFrame, benchmark: DataFrame) -> Iterator[Items]:
    for items in blocks(benchmark):
        items.choose(occurrences(docs, items))
        yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and benchmark item that stands in it, with the score and the words that it takes there."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], MATCHES)
    for items in seeded(rows, benchmark):
        out = out.unionByName(rows.mapInArrow(searched(spark, items, threshold), MATCHES))
    return out


def searched(spark: SparkSession, items: Items, threshold: float):  # noqa: ANN201
    shared = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in small(batches):
            found = list(matches(batch.column(1), shared.value, threshold, known))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([shared.value.ids[f[1]] for f in found], pa.int64()),
                    *(pa.array([f[i] for f in found], pa.float64() if i == 2 else pa.int64()) for i in (2, 3, 4)),
                ],
                ["doc_id", "item_id", "score", "first_word", "last_word"],
            )

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, whole, that have no item."""
    spark = docs.sparkSession
    place = docs.columns.index("text")
    out = docs
    for items in seeded(docs, benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            known: dict = {}
            for batch in small(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in matches(batch.column(place), shared.value, threshold, known)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
