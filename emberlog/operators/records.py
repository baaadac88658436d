"""Record assembly: header lines open records, other lines extend them.

Two inputs, one contract. ``pieces_from_text`` cuts a whole file inside its own row and shuffles
nothing. ``pieces_from_lines`` starts from a table of lines. Both give *pieces*:

    container_id, rec_no, level, raw

where raw keeps the line feeds of the file, the lines before the first header are record 0 with
a null level, and record numbers are dense.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.catalogue import CATALOGUE, HEADER, ROOT_CAUSE, SEPARATOR
from emberlog.functions.text import any_keyword, header_level, is_header, is_known, is_short_header, joined, let, line_count
from emberlog.operators.ordering import ROWS_PER_CHUNK, record_chunk, running_counts, running_last

_BREAK_BEFORE_HEADER = rf"\n(?={HEADER})"


# --- pieces ---------------------------------------------------------------------------------


def split_records(value: Column) -> Column:
    """Whole text to the array of its raw records, the lines before the first header in front."""
    return F.split(value, _BREAK_BEFORE_HEADER, -1)


def pieces_from_text(files: DataFrame) -> DataFrame:
    """``(container_id, value)`` with one whole file per row to pieces, without a shuffle."""
    # The flag is taken before the cut: beside it, it would be taken again for every record.
    opened = files.select("container_id", "value", is_header(F.col("value")).cast("long").alias("_opens"))
    cut = opened.select("container_id", "_opens", F.posexplode(split_records(F.col("value"))).alias("_pos", "raw"))
    return _with_level(cut.select("container_id", (F.col("_pos") + F.col("_opens")).alias("rec_no"), "raw"))


def _joined_in_order(order: str, text: str, separator: str) -> Column:
    """Texts of one record in order. The group is no larger than the value that comes out."""
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(parts, lambda part: part[text]), separator)


def number_lines(lines: DataFrame, order: Sequence[str], chunk: str | None = None) -> DataFrame:
    """Add ``line_no`` from 1 and ``rec_no`` (0 before the first header)."""
    return running_counts(
        lines,
        "container_id",
        list(order),
        chunk,
        line_no=F.lit(1),
        rec_no=is_header(F.col("line")),
    )


def pieces_from_lines(
    lines: DataFrame, order: Sequence[str], chunk: str | None = None, levels: Sequence[str] = ()
) -> DataFrame:
    """``(container_id, line, <order>)`` to pieces.

    Without chunks one shuffle by container serves the numbering and the grouping. With ``levels``,
    lines of records of other levels are dropped before records are assembled.
    """
    raw = _joined_in_order("line_no", "line", "\n")
    numbered = number_lines(lines, order, chunk)
    if levels:
        own = F.max(F.when(is_header(F.col("line")), header_level(F.col("line"))))
        numbered = numbered.withColumn("_level", own.over(Window.partitionBy("container_id", "rec_no")))
        numbered = numbered.filter(F.col("_level").isin(*levels))
    grouped = numbered.groupBy("container_id", "rec_no").agg(raw.alias("raw"))
    return _with_level(grouped)


def _with_level(pieces: DataFrame) -> DataFrame:
    level = F.when(F.col("rec_no") > 0, header_level(F.col("raw")))
    return pieces.select("container_id", "rec_no", level.alias("level"), "raw")


#: Seeds of the two hashes that stand for a text.
SEEDS = (1, 2)


def hash_names() -> list[str]:
    return [f"hash_{seed}" for seed in SEEDS]


def hash_of_parts(place: Column) -> list[Column]:
    """Aggregates: the two hashes of a whole, from those of its parts and their places in it, in any order."""
    return [F.bit_xor(F.xxhash64(F.lit(seed), place, *hash_names())).alias(f"hash_{seed}") for seed in SEEDS]


def line_facts(
    lines: DataFrame, order: Sequence[str], chunk: str | None = None, keywords: Sequence[str] = (), hashes: bool = False
) -> DataFrame:
    """Facts of each piece, from facts of its lines; no text is shuffled.

    ``container_id, rec_no, level, n_lines, n_chars`` (of the joined record), ``cause``, ``hit``
    (has a keyword), and for each kind of the catalogue ``mask_<kind>`` with a bit for each phrase. A
    phrase or keyword has no separator in it, so no match crosses the border of two lines. With
    ``hashes``, ``hash_1`` and ``hash_2`` stand for the text: hashes of lines with their places in the
    piece, which are known when lines are numbered.
    """
    line, header = F.col("line"), is_header(F.col("line"))
    masks = {kind: phrase_mask(line, texts) for kind, texts in CATALOGUE.items()}
    facts = lines.select(
        "container_id",
        *order,
        *([chunk] if chunk else []),
        header.alias("header"),
        F.when(header, header_level(line)).alias("level"),
        (F.length(line) + len(SEPARATOR)).cast("long").alias("n_chars"),
        F.contains(line, F.lit(ROOT_CAUSE)).alias("cause"),
        any_keyword(line, list(keywords)).alias("hit"),
        *[mask.alias(f"mask_{kind}") for kind, mask in masks.items()],
        *([F.xxhash64(F.lit(seed), line).alias(f"hash_{seed}") for seed in SEEDS] if hashes else []),
    )
    numbered = running_counts(facts, "container_id", list(order), chunk, rec_no=F.col("header"), **({"line_no": F.lit(1)} if hashes else {}))
    if hashes:
        numbered = running_last(numbered, "container_id", list(order), chunk, opened=F.when(F.col("header"), F.col("line_no")))
    return numbered.groupBy("container_id", "rec_no").agg(
        *(hash_of_parts(F.col("line_no") - F.coalesce("opened", F.lit(0))) if hashes else []),
        F.max("level").alias("level"),
        F.count("*").alias("n_lines"),
        F.sum("n_chars").alias("n_chars"),
        F.bool_or("cause").alias("cause"),
        F.bool_or("hit").alias("hit"),
        *[F.bit_or(f"mask_{kind}").alias(f"mask_{kind}") for kind in masks],
    )


def merged_facts(facts: DataFrame, chunk: bool = False, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``container_id, seg, level, n_chars, cause, hash_1, hash_2`` of merged records, from facts with hashes.

    A header line always opens a record, so equal texts are equal sequences of records, and are hashed as such.
    """
    place = F.col("known_no") - F.col("opened_at")
    return merge_gaps(facts, chunk, rows_per_chunk, [F.sum("n_chars").alias("n_chars"), F.bool_or("cause").alias("cause"), *hash_of_parts(place)])


def phrase_mask(text: Column, phrases: Sequence[str]) -> Column:
    """A bit for each phrase that ``text`` contains."""
    if any(SEPARATOR in phrase for phrase in phrases):
        raise ValueError("a phrase with the separator may cross lines")
    if len(phrases) > 63:
        raise ValueError(f"a mask has bits for 63 phrases, not {len(phrases)}; patterns.hits has no such limit")
    mask = F.lit(0).cast("long")
    for bit, phrase in enumerate(phrases):
        mask = mask.bitwiseOR(F.when(F.contains(text, F.lit(phrase)), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return mask


def drop_short_header_lines(lines: DataFrame) -> DataFrame:
    """Remove all lines of containers with a header of fewer than three tokens."""
    short = lines.filter(is_short_header(F.col("line"))).select("container_id").distinct()
    return lines.join(short, "container_id", "left_anti")


# --- records, one per header ----------------------------------------------------------------


def records(pieces: DataFrame) -> DataFrame:
    """Pieces with their joined text and number of lines."""
    return pieces.select(
        "container_id",
        "rec_no",
        "level",
        line_count(F.col("raw")).alias("n_lines"),
        joined(F.col("raw")).alias("record"),
    )


def of_level(recs: DataFrame, level: str) -> DataFrame:
    """Records of one level; INFO only with a root cause."""
    return kept(recs.filter(F.col("level") == level))


def is_kept(level: Column, record: Column) -> Column:
    return level.isin("ERROR", "WARN") | ((level == "INFO") & F.contains(record, F.lit(ROOT_CAUSE)))


def kept(recs: DataFrame) -> DataFrame:
    """ERROR and WARN records, and INFO records with a root cause."""
    return recs.filter(is_kept(F.col("level"), F.col("record")))


# --- records, merged over gaps of unknown level ---------------------------------------------
#
# A record of unknown level ends nothing: the next record of the level before it continues the
# open segment. Text of unknown records is dropped, and a file whose last header is unknown
# loses its open segment.


def segments_from_text(files: DataFrame) -> DataFrame:
    """Whole files to ``(container_id, seg, level, record)``, each file inside its own row.

    Files with a short header give no rows.
    """
    found = let(split_records(F.col("value")), segments_of)
    return files.select("container_id", F.posexplode(found).alias("_pos", "_seg")).select(
        "container_id",
        (F.col("_pos") + 1).cast("long").alias("seg"),
        F.col("_seg.level").alias("level"),
        F.col("_seg.record").alias("record"),
    )


def segments_of(pieces: Column) -> Column:
    """Pieces of one file to the array of its merged ``(level, record)``, in linear time.

    Null if one of its headers has fewer than three tokens.
    """
    first = F.when(is_header(F.get(pieces, F.lit(0))), F.lit(1)).otherwise(F.lit(2))
    headed = F.slice(pieces, first, F.greatest(F.size(pieces) - first + 1, F.lit(0)))

    def with_records(recs: Column) -> Column:
        return let(F.transform(recs, header_level), lambda levels: checked(recs, levels))

    def checked(recs: Column, levels: Column) -> Column:
        return F.when(~F.array_contains(levels, ""), with_levels(recs, levels))

    def with_levels(recs: Column, levels: Column) -> Column:
        positions = F.filter(
            F.transform(levels, lambda level, i: F.when(is_known(level), i)), lambda i: i.isNotNull()
        )
        return let(positions, lambda known: with_known(recs, levels, known))

    def with_known(recs: Column, levels: Column, known: Column) -> Column:
        def opens(i: Column, k: Column) -> Column:
            before = F.get(known, k - 1)
            return (k == 0) | (F.get(levels, i) != F.get(levels, before)) | (i == before + 1)

        starts = F.filter(F.transform(known, lambda i, k: F.when(opens(i, k), k)), lambda k: k.isNotNull())
        return let(starts, lambda opened: build(recs, levels, known, opened))

    def build(recs: Column, levels: Column, known: Column, opened: Column) -> Column:
        def segment(k: Column, s: Column) -> Column:
            end = F.coalesce(F.get(opened, s + 1), F.size(known))
            texts = F.transform(F.slice(known, k + 1, end - k), lambda i: joined(F.get(recs, i)))
            return F.struct(
                F.get(levels, F.get(known, k)).alias("level"), F.array_join(texts, "").alias("record")
            )

        open_end = ~is_known(F.get(levels, F.size(levels) - 1))
        survivors = F.size(opened) - F.when(open_end, F.lit(1)).otherwise(F.lit(0))
        return F.transform(F.slice(opened, F.lit(1), F.greatest(survivors, F.lit(0))), segment)

    return let(headed, with_records)


def merge_gaps(
    recs: DataFrame, chunk: bool = False, rows_per_chunk: int = ROWS_PER_CHUNK, merged: Sequence[Column] | None = None
) -> DataFrame:
    """Records to ``(container_id, seg, level, record)``; the form for records from lines.

    ``chunk`` is for data in which a container is too large for one task. ``merged`` are other
    aggregates than the joined text, for facts of records.
    """
    headed = recs.filter(F.col("rec_no") > 0)
    known = is_known(F.col("level"))
    if chunk:
        headed = headed.withColumn("_part", record_chunk(rows_per_chunk))
        seen = _carry_levels(headed)
    else:
        by_record = Window.partitionBy("container_id").orderBy("rec_no")
        before = by_record.rowsBetween(Window.unboundedPreceding, -1)
        seen = headed.withColumns(
            {
                "_any": F.lag("level").over(by_record),
                "_known": F.last(F.when(known, F.col("level")), ignorenulls=True).over(before),
                "_final": F.last("level").over(
                    by_record.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
                ),
            }
        )
    continues = F.coalesce((F.col("level") == F.col("_known")) & ~is_known(F.col("_any")), F.lit(False))
    numbered = running_counts(
        seen,
        "container_id",
        ["rec_no"],
        "_part" if chunk else None,
        totals=True,
        seg=known & ~continues,
    )
    lost = ~is_known(F.col("_final")) & (F.col("seg") == F.col("seg_total"))
    if set(hash_names()) <= set(recs.columns):  # a record's place in its segment
        numbered = running_counts(numbered, "container_id", ["rec_no"], "_part" if chunk else None, known_no=known)
        numbered = running_last(numbered, "container_id", ["rec_no"], "_part" if chunk else None, opened_at=F.when(known & ~continues, F.col("known_no")))
    return (
        numbered.filter(known & ~lost)
        .groupBy("container_id", "seg")
        .agg(
            F.max("level").alias("level"),
            *(merged or [_joined_in_order("rec_no", "record", "").alias("record")]),
        )
    )


def _carry_levels(headed: DataFrame) -> DataFrame:
    """Level of the record before, last known level before, and last level, over chunks."""
    known_level = F.when(is_known(F.col("level")), F.col("level"))
    ends = headed.groupBy("container_id", "_part").agg(
        F.max_by("level", "rec_no").alias("_end_any"),
        F.expr("max_by(level, rec_no) filter (where level in ('ERROR', 'WARN', 'INFO'))").alias("_end_known"),
    )
    chunks = Window.partitionBy("container_id").orderBy("_part")
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    whole = chunks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select(
        "container_id",
        "_part",
        F.lag("_end_any").over(chunks).alias("_in_any"),
        F.last("_end_known", ignorenulls=True).over(before).alias("_in_known"),
        F.last("_end_any").over(whole).alias("_final"),
    )
    local = Window.partitionBy("container_id", "_part").orderBy("rec_no")
    return (
        headed.withColumns(
            {
                "_any": F.lag("level").over(local),
                "_known": F.last(known_level, ignorenulls=True).over(
                    local.rowsBetween(Window.unboundedPreceding, -1)
                ),
            }
        )
        .join(carried, ["container_id", "_part"], "left")
        .withColumns(
            {
                "_any": F.coalesce("_any", "_in_any"),
                "_known": F.coalesce("_known", "_in_known"),
            }
        )
    )
