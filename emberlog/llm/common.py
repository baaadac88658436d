"""Helpers that several operators share: checkpoints, checked broadcasts, texts of an Arrow batch."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as ``bytes.split()`` takes it: blank and 0x09 to 0x0D.
BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: Rows of a side that may be broadcast; the rows are counted before.
BROADCAST_ROWS = 100_000


def reachable(spark: SparkSession) -> None:
    """Lets Python workers find this package where the session was begun in another folder."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, else one of our own.

    Where the setting is missing, a local session takes a temporary folder and a cluster the warehouse.
    """
    context = spark.sparkContext
    if not (given := context.getCheckpointDir()):
        if not (given := spark.conf.get("spark.checkpoint.dir", None)):
            local = context.master == "local" or context.master.startswith("local[")
            given = tempfile.mkdtemp(prefix="emberlog-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(given)
        given = context.getCheckpointDir()
    return given


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which is cut and narrow, with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once: a lambda's variable is never put in place of its uses."""
    return F.transform(F.array(value), body).getItem(0)


def running(steps: Column, block: int = 256) -> Column:
    """Running sums of an array of longs, in time that grows with its length.

    Appending to an array copies it, so sums are made inside blocks, and blocks begin with the sums of those before.
    """

    def sums(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda done, step: F.concat(done, F.array(F.element_at(done, -1) + step)))

    def of_blocks(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + b))
        return let(sums(totals, F.lit(0).cast("long")), lambda before: F.flatten(F.transform(parts, lambda part, i: let(sums(part, F.get(before, i)), lambda s: F.slice(s, 2, F.size(part))))))

    def cut_up(steps: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0)), F.lit(block))
        return let(F.transform(numbers, lambda at: F.slice(steps, at + 1, F.lit(block))), of_blocks)

    return let(F.transform(steps, lambda step: step.cast("long")), cut_up)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of a batch at once stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column, and where each begins (one more: the end). Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    data, starts = buffers(column)
    view = memoryview(data)
    for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield view[start:end].tobytes()


def pieces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``text`` cut at white space into pieces of about ``size`` bytes, so that a very long text needs little memory."""
    if len(text) <= size:
        yield text
        return
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            found = BLANK.search(text, end)
            end = found.end() if found else len(text)
        yield text[start:end]
        start = end
