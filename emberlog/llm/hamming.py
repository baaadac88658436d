"""Block tables over 64-bit fingerprints, links inside a bucket, and components of links.

Two fingerprints that differ in at most ``radius`` bits agree in one of ``radius + 1`` blocks of bits, in two of
``radius + 2`` blocks, and so on. Each way to choose the agreeing blocks is a table, and the chosen bits are the key
of a bucket in it. Fingerprints are distinct here, so copies cost nothing.

A bucket never gives all its pairs: a task finds the components inside it and gives an edge from each member to
their smallest one. A bucket with more rows than ``bucket_rows`` is cut into chunks by a hash, and each pair of
chunks is a task's unit, so every two members still meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import cut, if_small, partitions

#: Rows that a bucket should have on average before another block is taken into the key.
MEAN_BUCKET = 2048
#: Pivots that are compared at once.
PIVOTS = 64

#: Gets fingerprints of pivots and of others; gives a matrix, true where a pair is within the radius.
Near = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def masks(radius: int, rows: int) -> list[int]:
    """Bit masks of the tables. More blocks agree, and buckets get smaller, as the number of rows grows."""
    for agree in (1, 2, 3, 4):
        blocks = radius + agree
        if rows / 2 ** (64 // blocks * agree) <= MEAN_BUCKET:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(block, agree)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def keyed(fingerprints: DataFrame, radius: int, rows: int) -> DataFrame:
    """A row for each fingerprint ``fp`` and table: ``slot`` (the table's number), ``key``, ``fp``."""
    one = [F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks(radius, rows))]
    return fingerprints.select("fp", F.explode(F.array(one)).alias("b")).select("b.slot", "b.key", "fp")


def dealt(buckets: DataFrame, bucket_rows: int) -> DataFrame:
    """``buckets`` with ``pair``: 0, or the number of a pair of chunks for buckets above ``bucket_rows`` rows."""
    large = cut(
        buckets.groupBy("slot", "key").count().where(F.col("count") > bucket_rows)
        .select("slot", "key", F.ceil(F.col("count") / bucket_rows).cast("long").alias("chunks"))
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    pair = F.when(F.col("chunks").isNull(), F.lit(0).cast("long")).otherwise(low * F.col("chunks") + high)
    return (
        buckets.join(if_small(large), ["slot", "key"], "left")
        .withColumn("mine", mine)
        .withColumn("other", other)
        .select("slot", "key", pair.alias("pair"), "fp")
    )


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Fingerprints of each bucket of sorted rows (slot, key, pair, fp), if there are two or more."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)], axis=1)
        if held:
            rows = np.concatenate([*held, rows])
        starts = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a > 1:
                yield rows[a:b, 3].astype(np.uint64)
        held = [rows[starts[-1] :]]
    if held and len(held[0]) > 1:
        yield held[0][:, 3].astype(np.uint64)


def inside(fps: np.ndarray, radius: int, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Members and the smallest member of their component, for members that are not it.

    Pivots are compared with all that were not reached yet. What a pivot reaches becomes a pivot later, but is not
    compared with others of its own component again, so a dense group costs about its size, not its square.
    """
    fps = np.unique(fps)
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    fresh = np.arange(len(fps))  # not reached
    waiting: dict[int, list[int]] = {}  # reached, not compared yet, by component
    while len(fresh) or waiting:
        if waiting:
            first = next(iter(waiting))
            queue = waiting.pop(first)
            if (now := root(first)) != first:
                waiting.setdefault(now, []).extend(queue)
                continue
            pivots, left = np.array(queue[:PIVOTS]), queue[PIVOTS:]
            others = [i for members in waiting.values() for i in members]
            seen = np.concatenate([fresh, np.array(others, np.int64)])
            if left:
                waiting[first] = left
        else:
            pivots = fresh[:PIVOTS]
            fresh = fresh[PIVOTS:]
            seen = np.concatenate([fresh, pivots])
        if not len(seen):
            continue
        hit = near(fps[pivots], fps[seen], radius)
        reached = np.zeros(len(seen), bool)
        for p, s in zip(*np.nonzero(hit), strict=True):
            a, b = root(int(pivots[p])), root(int(seen[s]))
            if a != b:
                parent[max(a, b)] = min(a, b)
            reached[s] = True
        new = reached[: len(fresh)]
        for i in fresh[new].tolist():
            waiting.setdefault(root(i), []).append(i)
        fresh = fresh[~new]
    tops = np.array([root(i) for i in range(len(fps))], np.int64)
    moved = np.flatnonzero(tops != np.arange(len(fps)))
    return fps[moved], fps[tops[moved]]


def edges(fingerprints: DataFrame, rows: int, radius: int, near: Near) -> DataFrame:
    """Edges (``a``, ``b``) whose components are those of all links within ``radius`` bits.

    ``fingerprints`` is cut and has distinct values ``fp`` (long); ``rows`` is their number.
    """
    spark = fingerprints.sparkSession
    dealing = partitions(spark)
    bucket_rows = min(65_536, max(512, rows * len(masks(radius, rows)) // (4 * dealing)))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in runs(batches):
            a, b = inside(members, radius, near)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])

    buckets = dealt(keyed(fingerprints, radius, rows), bucket_rows)
    return (
        buckets.repartition(dealing, "slot", "key", "pair")
        .sortWithinPartitions("slot", "key", "pair")
        .mapInArrow(links, "a long, b long")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``a``, ``b``: each node that has an edge and is not the smallest of its component, with that smallest one.

    Large and small stars in turn, until every tree is a star. A round needs the smallest neighbour of each node,
    which is aggregated before the shuffle, and a join by node, whose large partitions Spark splits.
    """

    def lowest(pairs: DataFrame, of: Column) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min(of), F.col("u")).alias("m"))

    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        large = both.where("v > u").join(lowest(both, F.col("v")), "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = lowest(down, F.col("v"))
        small = (
            down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(low.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        edges = cut(small)
        open_ends = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a").distinct(), "a", "left_semi")
        several = edges.groupBy("a").count().where("count > 1")
        if open_ends.isEmpty() and several.isEmpty():
            break
    return edges


def classes(rows: DataFrame, radius: int, near: Near) -> DataFrame:
    """``rows`` (``doc_id``, ``fp``; cut) with ``component_id``, the smallest ``doc_id`` that links within ``radius`` reach,
    and ``top``, the fingerprint that stands for the component.

    Links between fingerprints are found among the distinct ones. A null ``doc_id`` is passed over when the smallest
    one is taken; a component without any other has null.
    """
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(edges(distinct, distinct.count(), radius, near))
    named = distinct.join(found.select(F.col("a").alias("fp"), F.col("b").alias("top")), "fp", "left").withColumn("top", F.coalesce("top", "fp"))
    # a component with a third of all fingerprints is added up before the shuffle, and its row goes to them
    groups = cut(named.groupBy("top").agg(F.min("least").alias("lowest"), F.count("*").alias("n")).where("n > 1").drop("n"))
    named = cut(named.join(if_small(groups), "top", "left").select("fp", "top", F.coalesce("lowest", "least").alias("component_id")))
    return rows.join(named, "fp")
