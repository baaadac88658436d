"""Report of a log collection as long rows ``(section, pattern_no, container_id, ord, text)``.

Sections: the three level lists, the phrase buckets of errors and warnings, and the keyword spans.
One row is one record or span, so a container of any size is spread over the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators import patterns
from emberlog.operators.containers import MARKER

BUCKETS = {"ERROR": "SpecificError", "WARN": "SpecificWarn"}


def rows(entry_rows: DataFrame) -> DataFrame:
    """Entries as report rows; a record is repeated for every phrase it contains. No shuffle."""
    return placed(entry_rows.filter(F.col("section") != MARKER))


def placed(entry_rows: DataFrame) -> DataFrame:
    """The same with the rows that make a container appear."""
    place = "struct<section:string,pattern_no:bigint>"
    section, text = F.col("section"), F.col("text")

    def bucket(kind: str) -> Column:
        found = patterns.matched(text, patterns.CATALOGUE[kind])
        return F.transform(found, lambda hit: F.struct(F.lit(BUCKETS[kind]), hit["pattern_no"]).cast(place))

    own = F.array(F.struct(section, F.lit(None).cast("long")).cast(place))
    places = own
    for kind in BUCKETS:
        places = F.when(section == kind, F.concat(own, bucket(kind))).otherwise(places)
    return (
        entry_rows.select("container_id", "ord", "text", F.explode(places).alias("_at"))
        .select("_at.section", "_at.pattern_no", "container_id", "ord", "text")
    )


def as_json(df: DataFrame, key: str = "container_id", column: str = "json") -> DataFrame:
    """``(key, json)``: every row as an object with its keys in alphabetical order."""
    return df.select(key, F.to_json(F.struct(*sorted(df.columns))).alias(column))


def write_json(df: DataFrame, path: str, partition_by: str | None = "section") -> None:
    """Write rows as JSON lines, keys in alphabetical order, with one folder per section if asked for."""
    writer = df.select(*sorted(df.columns)).write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)
