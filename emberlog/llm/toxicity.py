"""Toxicity by a chain of linear classifiers.

Categories are predicted in order, and the probability of each earlier one is a feature of the later ones. While the
chain is trained, a later model sees out-of-fold probabilities: those of models that were fitted without the document.
A model is a logistic regression with ridge penalty over the presence of words and of words' beginnings (4 and 5
bytes), over which of them are dense (repeated, and at least ``DENSE`` of all words), and a few measures of form. The most telling of the words and beginnings are chosen on the training part alone.

The chain is fitted in one task on at most about ``SAMPLE`` labelled documents, chosen by a hash of their identifier:
the bound is a parameter. Everything else covers all documents and whole texts.

Defined cases: a null or blank text has no words and gets the probabilities that follow from that; a document without
label is predicted like others; a null label leaves its row out of training; of labels that repeat for a document each
is a training row; if a category has one value only, its probability is the share of that value; with no label at all
every probability is 0 and nothing is toxic; an empty table gives none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import buffers, cut, small
from emberlog.llm.words import mixed, words

#: Labelled documents that the chain is fitted on at most, about.
SAMPLE = 10_000
FOLDS, FEATURES, RIDGE, STEPS = 5, 384, 1.0, 12
#: Bytes of the words' beginnings that are features.
HEADS = (4, 5)
#: Share of a text's words from which a word or beginning that repeats counts as dense.
DENSE = 0.007
#: A word or beginning is a feature if so many training documents have it.
LEAST = 5
FORMS = 7

DENSE_SALT = np.uint64(0x5BE0CD19137E2179)
#: Kinds of bytes: capitals 1, marks 2, digits 3, others 0.
KIND = np.zeros(256, np.uint8)
KIND[65:91] = 1
KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
KIND[48:58] = 3


def byte_kinds(data: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    return sum((np.bincount(KIND[data[i : i + at_once]], minlength=4) for i in range(0, len(data), at_once)), np.zeros(4, np.int64))


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct hashes of the words and beginnings, and the measures of form, of each text."""
    data, starts = buffers(column)
    salts = [np.uint64(0x1F83D9ABFB41BD6B * (i + 1) & (1 << 64) - 1) for i in range(len(HEADS))]
    for part in words(column, HEADS):
        heads = [mixed(h ^ s) for h, s in zip(part.heads, salts, strict=True)]
        for row, at in part.texts():
            own, often = np.unique(part.hashes[at], return_counts=True)
            n = at.stop - at.start
            kinds = byte_kinds(data[starts[row] : starts[row + 1]])
            form = [
                np.log1p(n) / 10,
                *(kinds[1:] / max(1, kinds.sum())),
                len(own) / n if n else 0.0,
                often.max() / n if n else 0.0,
                (part.hashes[at][1:] == part.hashes[at][:-1]).mean() if n > 1 else 0.0,
            ]
            begins, repeats = np.unique(np.concatenate([h[at] for h in heads]), return_counts=True)
            every, times = np.concatenate([own, begins]), np.concatenate([often, repeats])
            dense = mixed(every[(times > 1) & (times >= DENSE * n)] ^ DENSE_SALT)
            yield np.unique(np.concatenate([every, dense])), np.array(form)


@dataclass
class Linear:
    """Logistic regression over ``hashes`` (sorted, presence) and dense values. While it is fitted, they are numbers of hashes."""

    hashes: np.ndarray
    weights: np.ndarray
    #: Mean and spread of the dense values.
    centre: np.ndarray
    spread: np.ndarray
    #: Probability for all if the category has one value only.
    constant: float | None = None

    def matrix(self, present: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        out = np.zeros((len(present), len(self.hashes) + dense.shape[1] + 1))
        for i, own in enumerate(present):
            at = np.searchsorted(own, self.hashes)
            out[i, : len(self.hashes)] = own[np.minimum(at, len(own) - 1)] == self.hashes if len(own) else 0
        out[:, len(self.hashes) : -1] = (dense - self.centre) / self.spread
        out[:, -1] = 1
        return out

    def predict(self, present: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(present), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.matrix(present, dense) @ self.weights, -30, 30)))


def frequent(present: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The hashes that ``LEAST`` documents have, and for each document the numbers of those it has, ascending."""
    every = np.concatenate([*present, np.zeros(0, np.uint64)])
    every.sort()
    begin = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
    known = every[begin[np.diff(np.r_[begin, len(every)]) >= LEAST]]
    if not len(known):
        return known, [np.zeros(0, np.int32) for _ in present]
    numbers = []
    for own in present:
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        numbers.append(at[known[at] == own].astype(np.int32))
    return known, numbers


def telling(present: list[np.ndarray], y: np.ndarray, number: int = FEATURES) -> np.ndarray:
    """The numbers whose share differs most between the values of ``y``, by the log odds ratio over its error."""
    every = np.concatenate([*present, np.zeros(0, np.int32)])
    both = np.bincount(every)
    yes = np.bincount(every, np.repeat(y, [len(p) for p in present]), len(both))
    no = both - yes
    n_yes, n_no = y.sum(), len(y) - y.sum()
    odds = np.log((yes + 0.5) / (n_yes - yes + 0.5)) - np.log((no + 0.5) / (n_no - no + 0.5))
    error = np.sqrt(1 / (yes + 0.5) + 1 / (n_yes - yes + 0.5) + 1 / (no + 0.5) + 1 / (n_no - no + 0.5))
    z = np.where(both >= LEAST, np.abs(odds) / error, 0)
    best = np.argsort(-z, kind="stable")[:number]
    return np.sort(best[z[best] > 2])


def fitted(present: list[np.ndarray], dense: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> Linear:
    """Logistic regression by Newton steps."""
    if not len(y) or y.min() == y.max():
        return Linear(np.zeros(0, np.uint64), np.zeros(1), np.zeros(0), np.ones(0), float(y.mean()) if len(y) else 0.0)
    spread = dense.std(axis=0)
    model = Linear(telling(present, y), np.zeros(0), dense.mean(axis=0), np.where(spread > 0, spread, 1))
    x = model.matrix(present, dense)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    weights = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) + penalty * weights
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-4:
            break
    model.weights = weights
    return model


@dataclass
class Chain:
    models: list[Linear] = field(default_factory=list)
    #: Probability from which the last category holds.
    threshold: float = 2.0

    def predict(self, present: list[np.ndarray], dense: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for model in self.models:
            out.append(model.predict(present, np.column_stack([dense, *out])))
        return out


def fit_chain(hashes: list[np.ndarray], dense: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> Chain:
    """Models in the order of the columns of ``labels``. ``fold`` tells which rows are left out together."""
    chain, earlier = Chain(), dense
    known, present = frequent(hashes)
    for column in range(labels.shape[1]):
        y = labels[:, column].astype(float)
        outside = np.zeros(len(y))
        for f in np.unique(fold):
            away, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            model = fitted([present[i] for i in rest], earlier[rest], y[rest])
            outside[away] = model.predict([present[i] for i in away], earlier[away])
        chain.models.append(fitted(present, earlier, y))
        earlier = np.column_stack([earlier, outside])
        chain.threshold = balanced(outside, y)
    for model in chain.models:
        model.hashes = known[model.hashes.astype(np.int64)]
    return chain


def balanced(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which predictions have the best F1; in the middle of the gap where several are as good."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    if not len(p) or not hits[-1]:
        return 2.0
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
    k = int(np.argmax(f1))
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + below) / 2)


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``order``, ``text``, ``low_quality`` and ``toxic`` of about ``sample`` documents that have both labels, by a hash."""
    known = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select(
        F.col("doc_id").cast("long").alias("_id"), (1 - F.col("quality")).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic")
    )
    number = known.count()
    order = F.xxhash64(F.col("_id"))
    chosen = known if number <= sample else known.where(F.pmod(order, F.lit(number)) < sample)
    chosen = cut(chosen.withColumn("order", order))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "_id").drop("_id")  # bounded by the sample


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain ``low_quality``, ``toxic``."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = list(features(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (1, 2, 3)), pa.array([p.tobytes() for p, _ in found], pa.binary()), pa.array([d.tobytes() for _, d in found], pa.binary())],
                ["low_quality", "toxic", "order", "present", "form"],
            )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "present", "toxic", "low_quality"])
        present = [np.frombuffer(p, np.uint64) for p in rows["present"]]
        dense = np.stack([np.frombuffer(d) for d in rows["form"]])
        chain = fit_chain(present, dense, rows[["low_quality", "toxic"]].to_numpy(), rows["order"].to_numpy() // 7 % FOLDS)
        return pd.DataFrame({"chain": [pickle.dumps(chain)]})

    found = (
        labelled(docs, labels, sample).select("text", "low_quality", "toxic", "order")
        .mapInArrow(measured, "low_quality int, toxic int, order long, present binary, form binary")
        .groupBy(F.lit(1).alias("all"))  # the sample, in one task
        .applyInPandas(fit, "chain binary")
        .first()
    )
    return pickle.loads(found["chain"]) if found else Chain([fitted([], np.zeros((0, FORMS)), np.zeros(0))] * 2)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``p_low_quality``, ``p_toxic`` and ``is_toxic`` of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = shared.value
        for batch in small(batches):
            ids, found = [], []
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for pair in [*features(batch.column(1)), None]:
                if pair is not None:
                    held.append(pair)
                if held and (pair is None or len(held) == 256):
                    found.append(np.stack(chain.predict([p for p, _ in held], np.stack([d for _, d in held])), axis=1))
                    held = []
            ids = batch.column(0)
            p = np.concatenate(found) if found else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([ids, pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= chain.threshold)], ["doc_id", "p_low_quality", "p_toxic", "is_toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, p_low_quality double, p_toxic double, is_toxic boolean")
