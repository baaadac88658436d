"""Running numbers inside a container, also where one container holds much of the data.

A window partitioned by container puts each container into one task. That is the cheapest plan
as long as no container is large. Where one is, its rows are cut into chunks: each chunk is
numbered on its own, and the totals of the earlier chunks of the container are added. Only the
chunk totals of a container meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one container that one task may sort.
ROWS_PER_CHUNK = 5_000_000


def cut_large_groups(
    df: DataFrame, key: str, positions: Sequence[Column], rows_per_chunk: int = ROWS_PER_CHUNK, at_most: int | None = None
) -> tuple[DataFrame, bool]:
    """Add ``chunk`` if some key has more than ``rows_per_chunk`` rows; say whether it was added.

    ``positions`` are whole numbers; rows are ordered by the first, then by the next. A large key
    is cut into equal ranges of the first, and a range that is still too large is cut again, so
    bursts are followed; rows with one value of the first are cut by the next one. ``chunk`` is the array of range numbers, which sorts like the rows. Every check
    is one pre-aggregated pass over key and position; none is made if the table is known to have
    ``at_most`` so many rows that no key can be large.
    """
    if at_most is not None and at_most <= rows_per_chunk:
        return df, False
    cut, was_cut = df.withColumn("chunk", F.expr("cast(array() as array<bigint>)")), False
    while True:
        large = (
            cut.groupBy(key, "chunk")
            .agg(
                F.count("*").alias("_n"),
                *[F.min(position).alias(f"_lo{i}") for i, position in enumerate(positions)],
                *[F.max(position).alias(f"_hi{i}") for i, position in enumerate(positions)],
            )
            .filter(F.col("_n") > rows_per_chunk)
            .filter(" or ".join(f"_hi{i} > _lo{i}" for i in range(len(positions))))
        )
        if large.isEmpty():
            return (cut, True) if was_cut else (df, False)
        part = F.lit(None).cast("long")
        for i, position in reversed(list(enumerate(positions))):
            low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
            width = (high - low + 1) / F.ceil(F.col("_n") / rows_per_chunk)
            part = F.when(high > low, F.floor((position - low) / width).cast("long")).otherwise(part)
        cut = (
            cut.join(large, [key, "chunk"], "left")
            .withColumn("chunk", F.concat("chunk", F.array(F.coalesce(part, F.lit(0)))))
            .drop("_n", *[f"_{end}{i}" for end in ("lo", "hi") for i in range(len(positions))])
        )
        was_cut = True


def running_counts(
    df: DataFrame, key: str, order: list[str], chunk: str | None = None, totals: bool = False, **flags: Column
) -> DataFrame:
    """Add one running count (inclusive, as long) per flag, in ``order`` within each ``key``.

    With ``chunk``, a column that does not decrease along the order, no key is put into one task.
    With ``totals``, the count over the whole key is added as ``<flag>_total``.
    """
    as_number = {name: flag.cast("long") for name, flag in flags.items()}
    if chunk is None:
        window = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumns({name: F.sum(flag).over(window) for name, flag in as_number.items()})
        if totals:
            whole = Window.partitionBy(key)
            out = out.withColumns({f"{name}_total": F.max(name).over(whole) for name in flags})
        return out

    local = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    sums = df.groupBy(key, chunk).agg(*[F.sum(flag).alias(f"_{name}") for name, flag in as_number.items()])
    carried = sums.select(
        F.col(key).alias("_key"),
        F.col(chunk).alias("_chunk"),
        *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in flags],
        *[F.sum(f"_{name}").over(whole).alias(f"_all_{name}") for name in flags],
    )
    numbered = df.withColumns({name: F.sum(flag).over(local) for name, flag in as_number.items()})
    joined = numbered.join(carried, (F.col(key) == F.col("_key")) & (F.col(chunk) == F.col("_chunk")), "left")
    out = joined.withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in flags})
    if totals:
        out = out.withColumns({f"{name}_total": F.col(f"_all_{name}") for name in flags})
    extra = [f"_{part}_{name}" for part in ("before", "all") for name in flags]
    return out.drop("_key", "_chunk", *extra)


def running_last(df: DataFrame, key: str, order: list[str], chunk: str | None = None, **values: Column) -> DataFrame:
    """Add the last value so far (the own row included) that isn't null, in ``order`` within each ``key``.

    As for ``running_counts``, no key is put into one task if there is a ``chunk``.
    """
    if chunk is None:
        window = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.last(value, ignorenulls=True).over(window) for name, value in values.items()})
    local = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumns({f"_own_{name}": value for name, value in values.items()})
    place = F.struct(*order)
    ends = marked.groupBy(key, chunk).agg(*[F.max_by(f"_own_{name}", F.when(F.col(f"_own_{name}").isNotNull(), place)).alias(f"_end_{name}") for name in values])
    carried = ends.select(
        F.col(key).alias("_key"),
        F.col(chunk).alias("_chunk"),
        *[F.last(f"_end_{name}", ignorenulls=True).over(earlier).alias(f"_in_{name}") for name in values],
    )
    seen = marked.withColumns({name: F.last(f"_own_{name}", ignorenulls=True).over(local) for name in values})
    joined = seen.join(carried, (F.col(key) == F.col("_key")) & (F.col(chunk) == F.col("_chunk")), "left")
    out = joined.withColumns({name: F.coalesce(name, f"_in_{name}") for name in values})
    return out.drop("_key", "_chunk", *[f"_{part}_{name}" for part in ("own", "in") for name in values])


def record_chunk(rows: int = ROWS_PER_CHUNK) -> Column:
    """Chunk of a record: record numbers are dense, so every chunk has at most ``rows`` records."""
    return F.floor(F.col("rec_no") / rows).cast("long")
