"""Keyword spans: the part of a record from its first line with the keyword on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.text import any_keyword, keyword_span, parse_keywords, trim_first_tab
from emberlog.operators.ordering import ROWS_PER_CHUNK, record_chunk, running_counts
from emberlog.operators.records import split_records


def spans_from_text(files: DataFrame, keywords: str | list[str], match: str | None = None) -> DataFrame:
    """Whole files to ``(container_id, hit_no, hit, n_match)`` without a shuffle.

    ``n_match`` is the number of lines of the span that have the keyword.
    """
    wanted = parse_keywords(keywords, match)
    found = (
        # A file without the keyword is dropped before it is cut.
        files.filter(any_keyword(F.col("value"), wanted))
        .select(
            "container_id",
            F.posexplode(
                F.filter(split_records(F.col("value")), lambda raw: any_keyword(raw, wanted))
            ).alias("_pos", "raw"),
        )
        .withColumn("hit_no", (F.col("_pos") + 1).cast("long"))
    )
    return _trimmed(found, wanted)


def spans(
    pieces: DataFrame,
    keywords: str | list[str],
    match: str | None = None,
    chunk: bool = False,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Pieces from lines to ``(container_id, hit_no, hit, n_match)``."""
    wanted = parse_keywords(keywords, match)
    found = pieces.filter(any_keyword(F.col("raw"), wanted))
    if chunk:
        found = found.withColumn("_part", record_chunk(rows_per_chunk))
        found = running_counts(found, "container_id", ["rec_no"], "_part", hit_no=F.lit(1))
    else:
        window = Window.partitionBy("container_id").orderBy("rec_no")
        found = found.withColumn("hit_no", F.row_number().over(window).cast("long"))
    return _trimmed(found, wanted)


def spans_of_each(
    pieces: DataFrame, keywords: list[str], chunk: bool = False, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """``(keyword, container_id, hit_no, hit)``: the spans of each keyword on its own, from one assembly."""
    has = {f"_hit{i}": any_keyword(F.col("raw"), [keyword]) for i, keyword in enumerate(keywords)}
    found = pieces.withColumns(has).filter(" or ".join(has))
    if chunk:
        found = found.withColumn("_part", record_chunk(rows_per_chunk))
    numbers = {f"_no{i}": F.col(f"_hit{i}") for i in range(len(keywords))}
    numbered = running_counts(found, "container_id", ["rec_no"], "_part" if chunk else None, **numbers)

    def span(i: int, keyword: str) -> Column:
        number = F.col(f"_no{i}")
        hit = trim_first_tab(number, keyword_span(F.col("raw"), [keyword]))
        return F.when(F.col(f"_hit{i}"), F.struct(F.lit(keyword).alias("keyword"), number.alias("hit_no"), hit.alias("hit")))

    each = F.array_compact(F.array(*[span(i, keyword) for i, keyword in enumerate(keywords)]))
    return numbered.select("container_id", F.explode(each).alias("_span")).select(
        "_span.keyword", "container_id", "_span.hit_no", "_span.hit"
    )


def _trimmed(found: DataFrame, wanted: list[str]) -> DataFrame:
    hit = keyword_span(F.col("raw"), wanted)
    matching = F.filter(F.split("raw", "\n", -1), lambda line: any_keyword(line, wanted))
    return found.select(
        "container_id", "hit_no", hit.alias("hit"), F.size(matching).cast("long").alias("n_match")
    ).withColumn("hit", trim_first_tab(F.col("hit_no"), F.col("hit")))


def hits_per_container(facts: DataFrame) -> DataFrame:
    """Number of spans per container from ``records.line_facts``; containers without one stay with zero."""
    return facts.groupBy("container_id").agg(F.count_if("hit").alias("n_hits"))
