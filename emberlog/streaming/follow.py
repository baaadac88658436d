"""Accumulation over runs: each run adds the log files that came since the last one.

The transformations are those of the batch report, and a record never leaves its file. Results of earlier runs stay in
the output folder; a file that was read is not read again. A container that is delivered again under another path, or
with other lists, is known by ``identity``: the state of the stream has a hash of its lists, so equal lists come once,
also after a restart, and changed ones are added as another entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.functions.text import parse_keywords
from emberlog.operators import containers
from emberlog.plans import report
from emberlog.sources.files import DEFAULT_PATTERN, LogFiles


def new_rows(
    spark: SparkSession, path: str, keyword: str = "", pattern: str = DEFAULT_PATTERN, identity: str | None = None
) -> DataFrame:
    """Streaming report rows of the files below ``path``.

    A file that is left out has one row of the section ``Quarantine``, with the reason as its text. ``identity`` is a
    pattern whose first match in the path names the container, such as ``container_[0-9_]+``; without it, or without a
    match, a path names itself.
    """
    texts = LogFiles(spark, path, pattern).stream_of_texts()
    if identity is not None:
        name = F.regexp_extract("container_id", identity, 0)
        texts = texts.withColumn("container_id", F.when(name != "", name).otherwise(F.col("container_id")))
    entries = containers.entries_from_text(texts, parse_keywords(keyword), left_out=F.col("reason"), once=identity is not None)
    return report.rows(entries)


def run_once(
    spark: SparkSession,
    path: str,
    output: str,
    checkpoint: str,
    keyword: str = "",
    pattern: str = DEFAULT_PATTERN,
    identity: str | None = None,
) -> StreamingQuery:
    """Process all new files, append their rows to ``output`` by section, and stop."""
    return (
        new_rows(spark, path, keyword, pattern, identity)
        .writeStream.format("json")
        .partitionBy("section")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
