"""SimHash fingerprints of documents and all fingerprints within a Hamming radius.

Terms are the text's words in threes. A term has the weight 1 + ln(number of its places) and votes with it for each
bit of its hash that is set, against each that isn't; a bit of the fingerprint is set if the votes for it win.

Fingerprints within the radius are found in permuted block tables (:mod:`emberlog.llm.hamming`): for each choice of
leading blocks the fingerprints are dealt and sorted by those bits, and rows that agree in them are compared by the
number of differing bits.

Defined cases: a null or blank text, and one without any word, has the fingerprint zero; fewer than three words are
one term; rows that repeat give equal rows; an empty table gives none. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import cut, partitions, small
from emberlog.llm.hamming import classes
from emberlog.llm.words import mixed, shingles, words

WIDTH, RADIUS = 3, 3
#: Code points of 1 / EDITED of a text are replaced in its edited form.
EDITED = 3


def votes(hashes: np.ndarray, width: int = WIDTH) -> int:
    """Fingerprint of a text with these words, as an unsigned number."""
    terms = shingles(hashes, width)
    if not len(terms):
        if not len(hashes):
            return 0
        terms = mixed(np.add.reduce(hashes * np.arange(1, len(hashes) + 1, dtype=np.uint64), keepdims=True))
    terms, places = np.unique(terms, return_counts=True)
    weights = (1 + np.log(places)).astype(np.float32)
    balance = np.zeros(64)
    for at in range(0, len(terms), 1 << 14):
        bits = np.unpackbits(terms[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        balance += weights[at : at + (1 << 14)] @ (2 * bits.astype(np.float32) - 1)
    return int(np.packbits(balance > 0, bitorder="little").view(np.uint64)[0])


def fingerprint(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """Fingerprint of each text of an Arrow column."""
    return np.array([votes(part.hashes[at], width) for part in words(column) for _, at in part.texts()], np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated cosine of the weighted terms: that of the angle which the share of differing bits stands for; 0 for an obtuse one."""
    return np.maximum(0.0, np.cos(math.pi / 64 * np.bitwise_count(a ^ b)))


def near(pivots: np.ndarray, others: np.ndarray, radius: int) -> np.ndarray:
    """Matrix of the pairs that differ in at most ``radius`` bits."""
    return np.bitwise_count(pivots[:, None] ^ others[None, :]) <= radius


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many code points from the start of ``following``."""
    part = len(text) // EDITED
    return text[: len(text) - part] + following[:part]


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows in ranges of ``doc_id``, each range from the highest to the lowest, and then the row that follows.

    ``bucket``, ``ghost`` (true for the row that follows the range), ``doc_id``, ``text``. The texts are shuffled once. Where
    ranges begin comes from quantiles of the identifiers, one for each shuffle partition; what follows a
    range is the highest row of the next lower one that has rows, and after the lowest comes the highest of all.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    shares = [i / parts for i in range(1, parts)]
    bounds = np.array((rows.select(F.percentile_approx("doc_id", shares, 20_000).alias("q")).first()["q"] if shares else None) or [], np.int64)

    @F.pandas_udf("long")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right"))

    rows = rows.select(bucket_of(order).alias("bucket"), order.alias("place"), F.xxhash64("text").alias("digest"), "doc_id", "text")
    heads = cut(rows.groupBy("bucket").agg(F.max_by(F.struct("place", "digest", "doc_id", "text"), F.struct("place", "digest")).alias("head")))
    used = sorted(r["bucket"] for r in heads.select("bucket").collect())  # at most one number for each shuffle partition
    before = spark.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "bucket long, goes long")
    ghosts = heads.join(F.broadcast(before), "bucket").select(F.col("goes").alias("bucket"), F.lit(True).alias("ghost"), "head.*")
    both = rows.select("bucket", F.lit(False).alias("ghost"), "place", "digest", "doc_id", "text").unionByName(ghosts)
    return (
        both.repartitionById(parts, F.col("bucket").cast("int"))
        .sortWithinPartitions("bucket", "ghost", F.desc("place"), F.desc("digest"))
        .select("ghost", "doc_id", "text")
    )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"


def compared(batches: Iterator[pa.RecordBatch], width: int = WIDTH) -> Iterator[pa.RecordBatch]:
    """Each row with the one that follows it in ``neighbours``."""
    held: tuple[bool, int | None, str, np.uint64] | None = None
    for batch in small(batches):
        ghost = batch.column(0).to_pylist()
        ids = batch.column(1).to_pylist()
        fps = fingerprint(batch.column(2), width)
        told = batch.column(2).to_pylist()
        if held is not None:
            ghost, ids, told, fps = [held[0], *ghost], [held[1], *ids], [held[2], *told], np.r_[held[3], fps]
        here = [i for i in range(len(ids) - 1) if not ghost[i]]
        changed = [edited(told[i], told[i + 1]) for i in here]
        changed_fps = fingerprint(pa.array(changed, pa.large_string()), width)
        own, after = fps[here], fps[[i + 1 for i in here]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in here], pa.int64()),
                pa.array([len(told[i]) for i in here], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array(own.view(np.int64)),
                pa.array(changed_fps.view(np.int64)),
                pa.array(likeness(own, changed_fps)),
                pa.array(likeness(own, after)),
            ],
            [c.split()[0] for c in SCHEMA.split(", ")],
        )
        held = (ghost[-1], ids[-1], told[-1], fps[-1])


def fingerprinted(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of each row and of its edited text, and ``class_id``: the smallest ``doc_id`` reached within ``radius`` bits."""
    found = classes(cut(neighbours(docs).mapInArrow(compared, SCHEMA)), radius, near)

    def digits(name: str) -> Column:
        return F.lower(F.lpad(F.hex(name), 16, "0"))

    return found.select(
        "doc_id", "n_chars", "edited_sha256", digits("fp").alias("fingerprint"), digits("edited_fp").alias("edited_fingerprint"),
        "near_edited", "near_next", F.col("component_id").alias("class_id"),
    )
