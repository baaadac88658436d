"""Log lines made from the ``events`` table: one container per user, one line per event.

A click is a continuation line, a purchase has a level without behaviour. The damaged variant
cuts some headers down to two tokens. The table stays partitioned as it is read; the order of the
lines inside a container is ``LINE_ORDER``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_ORDER = ("ts", "event_id")

# Columns that are used; stating them saves a look at the files before every query.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string",
    "documents": "doc_id bigint, text string",
    "customer": "c_name string, c_mktsegment string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def event_lines(events: DataFrame, damaged: bool = False) -> DataFrame:
    """``(container_id, ts, event_id, line)``."""
    event_id = F.col("event_id")
    kind = F.col("event_type")
    written = F.col("ts").cast("string")  # without a zone, so the session's has no effect
    stamp = F.concat(F.translate(F.substring(written, 3, 8), "-", "/"), F.lit(" "), F.substring(written, 12, 8))
    cause = F.when(event_id % 3 == 0, " Caused by: x").otherwise("")
    frame = F.concat(F.lit("\tat frame("), event_id.cast("string"), F.lit(")"), cause)
    level = (
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").when(kind == "view", "INFO").otherwise("DEBUG")
    )
    component = (
        F.when(event_id % 5 == 0, "Executor")
        .when(event_id % 5 == 1, "TaskSetManager")
        .when(event_id % 5 == 2, "Utils")
        .when(event_id % 5 == 3, "MemoryStore")
        .otherwise("YarnAllocator: Container from a bad node")
    )
    line = F.when(kind == "click", frame)
    if damaged:
        line = line.when(event_id % 997 == 0, stamp)
    line = line.otherwise(F.concat(stamp, F.lit(" "), level, F.lit(" "), component, F.lit(": "), "props"))
    return events.select(F.col("user_id").alias("container_id"), "ts", "event_id", line.alias("line"))


def second_run(lines: DataFrame) -> DataFrame:
    """Lines of a later run over the same containers, some of which have changed.

    A third of the containers lost their WARN headers, a fifth have other names. Half of them begin
    with one more record of an unknown level, which is in no list of theirs.
    """
    container = F.col("container_id")
    start = lines.groupBy("container_id").agg(F.min("ts").alias("ts")).filter(container % 2 == 0)
    start = start.select("container_id", "ts", F.lit(-1).cast("long").alias("event_id"), F.lit("70/01/01 00:00:00 DEBUG Utils: start").alias("line"))
    gone = (container % 3 == 1) & F.col("line").rlike("^[^ ]+ [^ ]+ WARN ")
    renamed = F.when(container % 5 == 4, container + 1_000_000).otherwise(container)
    return lines.filter(~gone).unionByName(start).withColumn("container_id", renamed)


def line_positions() -> list[Column]:
    """Whole numbers with the order of ``LINE_ORDER``."""
    days = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    minutes = (days * 24 + F.hour("ts")) * 60 + F.minute("ts")
    micros = minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), F.col("ts")) * 1_000_000).cast("long")
    return [micros, F.col("event_id")]


def documents_as_logs(documents: DataFrame) -> DataFrame:
    """Every document as one whole log: some of its lines become headers, by their number."""

    def line(text: Column, i: Column) -> Column:
        short = (F.col("doc_id") % 50 == 7) & (i == 1)
        level = (
            F.when(i % 5 == 1, "ERROR").when(i % 5 == 2, F.when(i % 10 == 2, "DEBUG").otherwise("ERROR"))
            .when(i % 7 == 4, "WARN").when(i % 7 == 5, "INFO")
        )
        headed = F.concat(F.lit("2020-06-06 22:25:17 "), level, F.when(i % 3 == 0, " Caused by: ").otherwise(" Executor: "), text)
        return F.when(short, F.lit("20/06/06")).otherwise(F.coalesce(headed, text))

    value = F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")
    return documents.select(F.col("doc_id").alias("container_id"), value.alias("value"))


def documents_as_text(documents: DataFrame) -> DataFrame:
    """Every document as one whole text."""
    return documents.select(F.col("doc_id").alias("container_id"), F.col("text").alias("value"))
