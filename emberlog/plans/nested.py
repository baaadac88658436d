"""The report as nested values: a row for each container, in parts if its texts are too long for one.

``container_id, part_no, res, SpecificError, SpecificWarn, Keyword, resLen, KeywordLen, flag``. ``res`` has the three
level lists, the buckets map a phrase to its records, ``Keyword`` is the list of spans. The last three are those of the
whole report and the same in each row: characters of the lists, and whether the spans are over the limit.

The rows of a container are laid end to end, by section, phrase and place, and cut so that no part has more than
``max_chars`` characters (a text counts one more, so empty ones add up as well). The width that makes this sure
follows from the longest text, which is counted first; a text that is longer than all that is a part of its own. Parts
of a container begin with 0 and may have gaps between their numbers. Only a part's texts meet in one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.catalogue import CATALOGUE, MAX_KEYWORD_CHARS
from emberlog.operators import patterns
from emberlog.operators.containers import KEYWORD
from emberlog.operators.ordering import ROWS_PER_CHUNK, running_counts
from emberlog.plans import report

#: Characters of the texts in one row. Together with its keys a row stays far below the 2 GB of a value.
MAX_CHARS = 64_000_000
TEXTS = "array<string>"
BUCKET = f"map<string,{TEXTS}>"


def with_parts(placed: DataFrame, max_chars: int = MAX_CHARS, chunk: bool = False, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``report.placed`` rows with ``part_no``. ``chunk`` is for data in which a container is too large for one task."""
    size = F.length(F.coalesce("text", F.lit(""))) + 1
    rows = placed.withColumns({"_phrase": F.coalesce("pattern_no", F.lit(-1)), "_size": size.cast("long")})
    longest = rows.agg(F.coalesce(F.max("_size"), F.lit(0)).alias("longest"))
    if chunk:
        rows = rows.withColumn("_range", F.struct("section", "_phrase", F.floor(F.col("ord") / rows_per_chunk).alias("range")))
    laid = running_counts(rows, "container_id", ["section", "_phrase", "ord"], "_range" if chunk else None, _end=F.col("_size"))
    width = F.greatest(F.lit(max_chars) - F.col("longest"), F.lit(1))
    part = F.floor((F.col("_end") - F.col("_size")) / width).cast("long")
    return laid.crossJoin(F.broadcast(longest)).select(*placed.columns, part.alias("part_no"))


def nested(
    entry_rows: DataFrame,
    max_chars: int = MAX_CHARS,
    max_keyword_chars: int = MAX_KEYWORD_CHARS,
    withhold: bool = False,
    chunk: bool = False,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Entries as nested rows. With ``withhold``, spans that are over their limit together are left out."""
    is_level = F.col("section").isin(*CATALOGUE, "INFO")
    chars = F.length("text").cast("long")
    sizes = entry_rows.agg(
        F.coalesce(F.sum(F.when(is_level, chars)), F.lit(0)).alias("resLen"),
        F.coalesce(F.sum(F.when(F.col("section") == KEYWORD, chars)), F.lit(0)).alias("KeywordLen"),
    ).withColumn("flag", (F.col("KeywordLen") > max_keyword_chars).cast("int"))
    if withhold:
        over = sizes.select("flag").scalar()
        entry_rows = entry_rows.filter((F.col("section") != KEYWORD) | (over == 0))
        sizes = sizes.withColumn("KeywordLen", F.when(F.col("flag") == 1, F.lit(0)).otherwise(F.col("KeywordLen")).cast("long"))
    parts = with_parts(report.placed(entry_rows), max_chars, chunk, rows_per_chunk)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda row: row["text"])
    lists = parts.groupBy("container_id", "part_no", "section", "pattern_no").agg(in_order.alias("texts"))
    # no phrase is in both kinds, so the number and the section name it
    names = patterns.catalogue(entry_rows.sparkSession).select(
        F.create_map(*[x for kind, name in report.BUCKETS.items() for x in (F.lit(kind), F.lit(name))])[F.col("kind")].alias("section"), "pattern_no", "pattern"
    )
    named = lists.join(F.broadcast(names), ["section", "pattern_no"], "left")

    def texts(section: str) -> Column:
        return F.coalesce(F.any_value(F.when(F.col("section") == section, F.col("texts")), True), F.expr(f"cast(array() as {TEXTS})"))

    def bucket(section: str) -> Column:
        found = F.collect_list(F.when(F.col("section") == section, F.struct("pattern", "texts")))
        return F.map_from_entries(F.sort_array(found)).cast(BUCKET)

    rows = named.groupBy("container_id", "part_no").agg(
        F.struct(*[texts(level).alias(level) for level in ("ERROR", "INFO", "WARN")]).alias("res"),
        *[bucket(section).alias(section) for section in report.BUCKETS.values()],
        texts(KEYWORD).alias("Keyword"),
    )
    return rows.crossJoin(F.broadcast(sizes))


def flat(rows: DataFrame) -> DataFrame:
    """Nested rows with each nested value as JSON, keys in alphabetical order."""
    return rows.select(*[F.to_json(name).alias(name) if kind.startswith(("struct", "map", "array")) else F.col(name) for name, kind in rows.dtypes])


def documents(rows: DataFrame) -> DataFrame:
    """``container_id, part_no, json``: each nested row as one object, keys in alphabetical order at every level."""
    return rows.select("container_id", "part_no", F.to_json(F.struct(*sorted(rows.columns))).alias("json"))
