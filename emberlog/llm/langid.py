"""Language of a text by its nearest centroid.

A text's vector counts its byte n-grams of one to three, hashed into ``DIMENSIONS`` places; each count becomes its
square root times the place's inverse document frequency, and the vector is brought to length 1. A language has
several centroids, found by clustering (spherical k-means) the vectors of its training documents, and a text gets the
language whose centroid has the largest cosine.

Document frequencies are counted over all training documents. Centroids are fitted on about ``SAMPLE`` documents of
each language, chosen by a hash of their identifier: the bound is a parameter. Each language is clustered in its own task.

A text whose cosine is below a share of what training texts of its length reach is rejected: its distance says that
it is in none of the languages. It still gets the nearest as ``lang_pred``.

Defined cases: a null text and one without letters is ``und``, with score 0, and rejected; with no training document
every text is ``und``; rows that repeat give equal rows; an empty table gives none. Identifier, source and language
are never part of a vector.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import cut, if_small, pieces, small, texts

DIMENSIONS = 4096
#: Centroids of a language, and training documents that they are fitted on at most, about.
CENTROIDS, SAMPLE = 4, 1000
FOLDS, ROUNDS = 5, 8
#: A cosine below this share of a low quantile of the training texts of the same length class is too far.
REJECT, QUANTILE = 0.5, 0.01
UNKNOWN = "und"

#: Letters of ASCII as they are, other ASCII as a blank.
LETTER = np.full(256, 32, np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)
ASCII_LETTER = re.compile(rb"[a-z]")


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode(errors="replace"))


def counts(text: bytes) -> np.ndarray:
    """Counts of the hashed n-grams of a text in small letters; all zero if it has no letter."""
    out = np.zeros(DIMENSIONS, np.int64)
    for piece in pieces(text):
        raw = LETTER[np.frombuffer(piece, np.uint8)]
        letters = np.flatnonzero(raw != 32)
        if not len(letters):
            continue
        data = np.concatenate([[32], raw, [32]]).astype(np.uint32)
        two = data[:-1] * np.uint32(257) + data[1:]
        three = two[:-1] * np.uint32(263) + data[2:]
        for salt, grams, solid in ((1, data, data != 32), (2, two, two != 32 * 257 + 32), (3, three, three != (32 * 257 + 32) * 263 + 32)):
            out += np.bincount(((grams[solid] * np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    return out


def vector(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighed = np.sqrt(count) * idf
    length = np.linalg.norm(weighed)
    return (weighed / length if length else weighed).astype(np.float32)


def length_class(count: np.ndarray) -> int:
    return int(count.sum()).bit_length()


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a document is kept from training: crc32 of its identifier as text is a multiple of ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def lowered(docs: DataFrame) -> Column:
    return F.lower(F.col("text").cast("string"))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    #: All centroids, a row each, and the number of the language of each.
    centroids: np.ndarray
    of: np.ndarray
    #: The smallest cosine that is not rejected, by language and length class.
    floors: np.ndarray

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        """Language, cosine, and whether it is too far from all."""
        if not len(self.languages) or not has_letter(text):
            return UNKNOWN, 0.0, True
        count = counts(text)
        cosines = self.centroids @ vector(count, self.idf)
        best = int(np.argmax(cosines))
        language, cosine = int(self.of[best]), min(1.0, max(0.0, float(cosines[best])))
        return self.languages[language], cosine, cosine < float(self.floors[language, min(length_class(count), 63)])


def clustered(vectors: np.ndarray, number: int = CENTROIDS) -> np.ndarray:
    """Spherical k-means. It begins with the mean's farthest row, then takes the row farthest from all centroids so far."""
    centre = vectors.mean(axis=0)
    centroids = vectors[[int(np.argmin(vectors @ centre))]]
    for _ in range(1, min(number, len(vectors))):
        far = int(np.argmin((vectors @ centroids.T).max(axis=1)))
        centroids = np.concatenate([centroids, vectors[[far]]])
    for _ in range(ROUNDS):
        own = np.argmax(vectors @ centroids.T, axis=1)
        means = np.stack([vectors[own == k].mean(axis=0) if (own == k).any() else centroids[k] for k in range(len(centroids))])
        lengths = np.linalg.norm(means, axis=1, keepdims=True)
        centroids = (means / np.where(lengths > 0, lengths, 1)).astype(np.float32)
    # a cluster of a few odd texts stands for no language
    sizes = np.bincount(np.argmax(vectors @ centroids.T, axis=1), minlength=len(centroids))
    return centroids[sizes >= max(1, len(vectors) // 50)]


def floors_of(vectors: np.ndarray, classes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each length class, ``REJECT`` times a low quantile of the cosines of training texts of about that length.

    A shorter text may be as far as a longer one. Below the shortest class that has training texts the floor
    falls by 0.7 with each class (half the length), above the longest it stays.
    """
    cosines = (vectors @ centroids.T).max(axis=1)
    floors = np.full(64, np.nan)
    for k in range(64):
        some = cosines[(classes <= k) & (classes >= k - 2)]
        if (classes == k).any() and len(some) >= 20:
            floors[k] = REJECT * np.quantile(some, QUANTILE)
    known = np.flatnonzero(~np.isnan(floors))
    if not len(known):
        return np.zeros(64)
    floors = np.fmin.accumulate(floors[::-1])[::-1]
    floors[known[-1] :] = floors[known[-1]]
    floors[: known[0]] = floors[known[0]] * 0.7 ** np.arange(known[0], 0, -1)
    return floors


def train(docs: DataFrame, folds: int = FOLDS, sample: int = SAMPLE) -> Model:
    """Model from the text and language of the documents that are not held out."""
    spark = docs.sparkSession
    known = docs.where(~held_out(F.col("doc_id"), folds) & F.col("lang").isNotNull()).select(
        F.xxhash64(F.col("doc_id").cast("string")).alias("order"), F.col("lang").cast("string").alias("lang"), lowered(docs).alias("text")
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = np.zeros(DIMENSIONS + 1, np.int64)  # last: documents with letters
        for batch in small(batches):
            for text in filter(has_letter, texts(batch.column(0))):
                count = counts(text)
                present[:-1] += count > 0
                present[-1] += bool(count.any())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(present)], ["place", "n"])

    found = known.select("text").mapInArrow(frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # a row per place
    present = np.zeros(DIMENSIONS + 1)
    present[found["place"].to_numpy(np.int64)] = found["n"].to_numpy()
    idf = np.log((1 + present[-1]) / (1 + present[:-1])) + 1

    per_language = cut(known.groupBy("lang").agg(F.count("*").alias("rows")))
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("rows"))
    chosen = known.join(if_small(per_language), "lang").where(F.pmod("order", F.lit(1_000_003)) / 1_000_003.0 < share)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            told = list(texts(batch.column(2)))
            keep = [i for i, t in enumerate(told) if has_letter(t)]
            found = {i: counts(told[i]) for i in keep}
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    batch.column(1).take(pa.array(keep, pa.int64())),
                    pa.array([length_class(found[i]) for i in keep], pa.int64()),
                    pa.array([vector(found[i], idf).tobytes() for i in keep], pa.binary()),
                ],
                ["order", "lang", "size", "vector"],
            )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "vector"])
        every = np.stack([np.frombuffer(v, np.float32) for v in rows["vector"]])
        centroids = clustered(every)
        floors = floors_of(every, rows["size"].to_numpy(), centroids)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [c.tobytes() for c in centroids], "floors": floors.tobytes()})

    fitted = (
        chosen.select("order", "lang", "text")
        .mapInArrow(vectors, "order long, lang string, size long, vector binary")
        .groupBy("lang")
        .applyInPandas(fit, "lang string, centroid binary, floors binary")
        .orderBy("lang", "centroid")
        .toPandas()  # a few rows for each language
    )
    languages = sorted(set(fitted["lang"]))
    number = {lang: i for i, lang in enumerate(languages)}
    return Model(
        languages,
        idf,
        np.stack([np.frombuffer(c, np.float32) for c in fitted["centroid"]]) if len(fitted) else np.zeros((0, DIMENSIONS), np.float32),
        np.array([number[lang] for lang in fitted["lang"]], np.int64),
        np.stack([np.frombuffer(fitted["floors"][fitted["lang"] == lang].iloc[0]) for lang in languages]) if languages else np.zeros((0, 64)),
    )


def identify(docs: DataFrame, folds: int = FOLDS, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` (cosine to the nearest centroid) and ``rejected`` of each row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, folds, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [model.value.predict(t) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.bool_()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds).alias("held_out"), lowered(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, folds: int = FOLDS, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, whole, whose text is in one of the learned languages."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, folds, sample))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            low = pc.utf8_lower(pc.fill_null(batch.column(place).cast(pa.large_string()), ""))
            yield batch.filter(pa.array([not model.value.predict(t)[2] for t in texts(low)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
