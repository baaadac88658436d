"""Failure phrases: which records contain which phrase of the catalogue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.catalogue import CATALOGUE


def catalogue(spark: SparkSession, phrases: Mapping[str, Sequence[str]] = CATALOGUE) -> DataFrame:
    """The phrases as a table ``(kind, pattern_no, pattern)``, numbered from 0 within a kind."""
    rows = [(kind, no, text) for kind, texts in phrases.items() for no, text in enumerate(texts)]
    columns = dict(zip(("kind", "pattern_no", "pattern"), zip(*rows)))
    return spark.createDataFrame(pa.table(columns))


def matched(record: Column, phrases: Sequence[str]) -> Column:
    """Array of ``(pattern_no, pattern)`` for the phrases that a record contains, in order."""
    tests = [
        F.when(
            F.contains(record, F.lit(text)),
            F.struct(F.lit(no).cast("long").alias("pattern_no"), F.lit(text).alias("pattern")),
        )
        for no, text in enumerate(phrases)
    ]
    return F.array_compact(F.array(*tests))


def hits(
    recs: DataFrame, kind: str, order: str = "rec_no", phrases: Mapping[str, Sequence[str]] = CATALOGUE
) -> DataFrame:
    """One row per record of level ``kind`` and phrase in it. The test is narrow: no join."""
    found = recs.filter(F.col("level") == kind).select(
        "container_id", order, "record", F.explode(matched(F.col("record"), phrases[kind])).alias("_hit")
    )
    return found.select(
        F.lit(kind).alias("kind"),
        F.col("_hit.pattern_no").alias("pattern_no"),
        F.col("_hit.pattern").alias("pattern"),
        "container_id",
        order,
        "record",
    )


def all_hits(recs: DataFrame, order: str = "rec_no", phrases: Mapping[str, Sequence[str]] = CATALOGUE) -> DataFrame:
    """Hits of every kind in one pass over the records."""
    per_kind = F.lit(None)
    for kind, texts in phrases.items():
        per_kind = F.when(F.col("level") == kind, matched(F.col("record"), texts)).otherwise(per_kind)
    found = recs.filter(F.col("level").isin(*phrases)).select(
        "container_id", order, "level", "record", F.explode(per_kind).alias("_hit")
    )
    return found.select(
        F.col("level").alias("kind"),
        F.col("_hit.pattern_no").alias("pattern_no"),
        F.col("_hit.pattern").alias("pattern"),
        "container_id",
        order,
        "record",
    )


def hits_of_facts(facts: DataFrame, phrases: Mapping[str, Sequence[str]] = CATALOGUE) -> DataFrame:
    """``(kind, pattern_no, container_id)`` of all hits, from ``records.line_facts`` of the same phrases."""

    def numbers(kind: str) -> Column:
        mask = F.col(f"mask_{kind}")
        tests = [F.when(mask.bitwiseAND(F.lit(1 << no).cast("long")) != 0, F.lit(no).cast("long")) for no in range(len(phrases[kind]))]
        return F.array_compact(F.array(*tests))

    found = F.lit(None)
    for kind in phrases:
        found = F.when(F.col("level") == kind, numbers(kind)).otherwise(found)
    return facts.filter(F.col("level").isin(*phrases)).select(
        F.col("level").alias("kind"), F.explode(found).alias("pattern_no"), "container_id"
    )


def summary(hit_rows: DataFrame, phrases: Mapping[str, Sequence[str]] = CATALOGUE) -> DataFrame:
    """Records and containers per phrase; phrases without a hit stay with zeros.

    Hits are counted per phrase and container first, so a frequent phrase is spread over tasks
    and the last step adds up partial sums.
    """
    per_container = hit_rows.groupBy("kind", "pattern_no", "container_id").agg(F.count("*").alias("n"))
    counted = per_container.groupBy("kind", "pattern_no").agg(
        F.sum("n").alias("n_records"), F.count("*").alias("n_containers")
    )
    return (
        catalogue(hit_rows.sparkSession, phrases)
        .join(counted, ["kind", "pattern_no"], "left")
        .select(
            "kind",
            "pattern_no",
            "pattern",
            F.coalesce("n_records", F.lit(0)).alias("n_records"),
            F.coalesce("n_containers", F.lit(0)).alias("n_containers"),
        )
    )
