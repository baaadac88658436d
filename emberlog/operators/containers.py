"""Per-container results, payload size, de-duplication over runs, keyed listing.

Nothing here collects the records of a container into one value: results are counts or long rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.catalogue import LEVELS, MAX_KEYWORD_CHARS
from emberlog.functions.text import any_keyword, keyword_span, let, trim_first_tab
from emberlog.operators.ordering import ROWS_PER_CHUNK, running_counts
from emberlog.operators.records import hash_names, is_kept, segments_of, split_records


def summary(recs: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Kept records per level and container; a container without any stays with zeros.

    Takes records or segments. Records before the first header have a null level and only make
    their container appear.
    """
    level, record = F.col("level"), F.col("record")
    keep = F.coalesce(is_kept(level, record), F.lit(False))
    return recs.groupBy("container_id").agg(
        F.count_if(level == "ERROR").alias("n_error"),
        F.count_if(level == "WARN").alias("n_warn"),
        F.count_if((level == "INFO") & keep).alias("n_info_kept"),
        F.coalesce(F.sum(F.when(keep, F.length(record))), F.lit(0)).alias("n_chars"),
        *[value.alias(name) for name, value in (extra or {}).items()],
    )


def summary_of_facts(facts: DataFrame) -> DataFrame:
    """The same from ``records.line_facts``, which carry no text."""
    level = F.col("level")
    keep = F.coalesce(level.isin("ERROR", "WARN") | ((level == "INFO") & F.col("cause")), F.lit(False))
    return facts.groupBy("container_id").agg(
        F.count_if(level == "ERROR").alias("n_error"),
        F.count_if(level == "WARN").alias("n_warn"),
        F.count_if((level == "INFO") & keep).alias("n_info_kept"),
        F.coalesce(F.sum(F.when(keep, F.col("n_chars"))), F.lit(0)).alias("n_chars"),
    )


def fingerprinted(
    facts: DataFrame, order: str = "seg", chunk: bool = False, rows_per_chunk: int = ROWS_PER_CHUNK, ids: DataFrame | None = None
) -> DataFrame:
    """Summary with a fingerprint of the three lists of the container, from ``records.merged_facts`` (or facts with hashes).

    A record's place is its number among the kept records of its level, so records that are in no
    list have no effect. Level, place and the hashes of the text are hashed with two seeds, and a container has the
    exclusive or of both hashes, the sum of a third one, and the number and length of its records:
    equal lists give equal fingerprints, and different ones the same by chance only: 128 bits stand for a text and 192 for
    the lists (hashes are not cryptographic). All of it can be built in any order and in parts, and no text is shuffled.
    ``ids`` has the ``container_id`` of all containers, also of those without any record.
    """
    level = F.col("level")
    keep = F.coalesce(level.isin("ERROR", "WARN") | ((level == "INFO") & F.col("cause")), F.lit(False))
    own = {f"_{name.lower()}": keep & (level == name) for name in ("ERROR", "WARN", "INFO")}
    if chunk:
        facts = facts.withColumn("_part", F.floor(F.col(order) / rows_per_chunk).cast("long"))
    numbered = running_counts(facts, "container_id", [order], "_part" if chunk else None, **own)
    place = F.coalesce(*[F.when(level == name[1:].upper(), F.col(name)) for name in own])

    def hashed(seed: int) -> Column:
        return F.when(keep, F.xxhash64(F.lit(seed), level, place, *hash_names()))

    found = numbered.groupBy("container_id").agg(
        F.count_if(level == "ERROR").alias("n_error"),
        F.count_if(level == "WARN").alias("n_warn"),
        F.count_if((level == "INFO") & keep).alias("n_info_kept"),
        F.sum(F.when(keep, F.col("n_chars"))).alias("n_chars"),
        F.bit_xor(hashed(1)).alias("fp_a"),
        F.bit_xor(hashed(2)).alias("fp_b"),
        F.sum(hashed(3).cast("decimal(38,0)")).alias("fp_c"),
    )
    if ids is not None:
        found = ids.join(found, "container_id", "left")
    zeros = {name: F.coalesce(name, F.lit(0)).cast("string" if name == "fp_c" else "long") for name in found.columns if name != "container_id"}
    return found.withColumns(zeros)


def accumulate(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of earlier runs stay; an entry with the same path and the same lists comes once."""
    return previous.unionByName(new).dropDuplicates()


# --- entries --------------------------------------------------------------------------------
#
# ``(container_id, section, ord, text)``: the kept records of a container under their level, its
# keyword spans, and one row of section MARKER that makes the container appear.

KEYWORD = "Keyword"
MARKER = "container"
QUARANTINE = "Quarantine"


def entries_from_text(
    files: DataFrame, keywords: list[str], levels: bool = True, left_out: Column | None = None, once: bool = False
) -> DataFrame:
    """Entries of whole files in one narrow pass; with levels, none of files with a short header.

    A file with a null value gives one entry of section QUARANTINE if ``left_out`` has a reason for it. With ``once``,
    files with the same ``container_id`` and equal lists give their entries once; of a stream, the hashes of the lists
    are the state that is kept.
    """
    entry = "array<struct<section:string,ord:bigint,text:string>>"
    marker = F.array(F.struct(F.lit(MARKER), F.lit(0), F.lit(None).cast("string"))).cast(entry)

    def numbered(parts: Column, section, text) -> Column:
        return F.transform(parts, lambda part, i: F.struct(section(part), (i + 1).cast("long"), text(part))).cast(entry)

    def of_pieces(pieces: Column) -> Column:
        found = [marker]
        if levels:
            # Null for a file with a short header, which makes the whole array null.
            found.append(numbered(segments_of(pieces), lambda seg: seg["level"], lambda seg: seg["record"]))
        if keywords:
            hits = F.filter(pieces, lambda raw: any_keyword(raw, keywords))
            found.append(numbered(hits, lambda raw: F.lit(KEYWORD), lambda raw: raw))
        return F.concat(*found)

    found = let(split_records(F.col("value")), of_pieces)
    if left_out is not None:
        why = F.array(F.struct(F.lit(QUARANTINE), F.lit(0), left_out)).cast(entry)
        found = F.when(F.col("value").isNotNull(), found).otherwise(F.when(left_out.isNotNull(), why))
    rows = files.select("container_id", found.alias("_found"))
    if once:
        rows = rows.withColumns({f"_hash{seed}": lists_hash(F.col("_found"), seed) for seed in (1, 2)})
        rows = rows.dropDuplicates(["container_id", "_hash1", "_hash2"])
    rows = rows.select("container_id", F.explode("_found").alias("_entry"))
    flat = rows.select("container_id", "_entry.section", "_entry.ord", "_entry.text")
    section, text = F.col("section"), F.col("text")
    kept = flat.filter(section.isin(KEYWORD, MARKER, QUARANTINE) | is_kept(section, text))
    if not keywords:
        return kept
    span = trim_first_tab(F.col("ord"), keyword_span(text, keywords))
    return kept.withColumn("text", F.when(section == KEYWORD, span).otherwise(text))


def lists_hash(found: Column, seed: int) -> Column:
    """Hash of the lists that the entries of a file make: by section, without the places of what is in none of them."""

    def texts(section: str) -> Column:
        own = F.filter(found, lambda entry: (entry["section"] == section) & (is_kept(entry["section"], entry["text"]) | F.lit(section in (KEYWORD, QUARANTINE))))
        return F.transform(own, lambda entry: entry["text"])

    return F.xxhash64(F.lit(seed), *[x for section in (*LEVELS, KEYWORD, QUARANTINE) for x in (F.lit(section), texts(section))])


def entries(ids: DataFrame, segments: DataFrame | None, spans: DataFrame | None) -> DataFrame:
    """The same rows from parts: container ids, merged records and keyword spans."""
    rows = ids.select(
        "container_id",
        F.lit(MARKER).alias("section"),
        F.lit(0).cast("long").alias("ord"),
        F.lit(None).cast("string").alias("text"),
    )
    if segments is not None:
        kept = segments.filter(is_kept(F.col("level"), F.col("record")))
        rows = rows.unionByName(
            kept.select(
                "container_id",
                F.col("level").alias("section"),
                F.col("seg").alias("ord"),
                F.col("record").alias("text"),
            )
        )
    if spans is not None:
        rows = rows.unionByName(
            spans.select(
                "container_id",
                F.lit(KEYWORD).alias("section"),
                F.col("hit_no").alias("ord"),
                F.col("hit").alias("text"),
            )
        )
    return rows


def entry_sizes(merged_facts: DataFrame, spans: DataFrame) -> DataFrame:
    """``(section, n_chars)`` of the kept records, from ``records.merged_facts`` without their texts, and of the spans."""
    keep = F.col("level").isin("ERROR", "WARN") | ((F.col("level") == "INFO") & F.col("cause"))
    kept_rows = merged_facts.filter(keep).select(F.col("level").alias("section"), "n_chars")
    return kept_rows.unionByName(spans.select(F.lit(KEYWORD).alias("section"), F.length("hit").cast("long").alias("n_chars")))


def sizes(entry_rows: DataFrame, limits: dict[str, int | None] | None = None) -> DataFrame:
    """``(section, n_items, n_chars, flag)``: texts and their characters, of level lists and keyword spans.

    Entries with ``n_chars`` in place of ``text`` do as well, see ``entry_sizes``.

    The flag is 1 if the characters are over the section's limit in ``limits``, by default
    ``MAX_KEYWORD_CHARS`` for keyword spans. The true size is reported in any case.
    """
    is_span, is_marker = F.col("section") == KEYWORD, F.col("section") == MARKER
    chars = (F.col("n_chars") if "n_chars" in entry_rows.columns else F.length("text")).cast("long")

    def total(what: Column, of: Column) -> Column:
        return F.coalesce(F.sum(F.when(of, what)), F.lit(0)).cast("long")

    found = entry_rows.agg(
        total(F.lit(1), is_span).alias("keyword_items"),
        total(chars, is_span).alias("keyword_chars"),
        total(F.lit(1), ~is_span & ~is_marker).alias("res_items"),
        total(chars, ~is_span & ~is_marker).alias("res_chars"),
    )

    def row(section: str, kind: str, limit: int | None) -> Column:
        over = F.col(f"{kind}_chars") > limit if limit is not None else F.lit(False)
        return F.struct(
            F.lit(section).alias("section"),
            F.col(f"{kind}_items").alias("n_items"),
            F.col(f"{kind}_chars").alias("n_chars"),
            over.cast("long").alias("flag"),
        )

    rows = [row("res", "res", None)]
    rows += [row(section, "keyword", limit) for section, limit in (limits or {KEYWORD: MAX_KEYWORD_CHARS}).items()]
    return found.select(F.inline(F.array(*rows)))


def withheld(entry_rows: DataFrame, spans: DataFrame, max_chars: int) -> DataFrame:
    """The entries, without keyword spans if these have more than ``max_chars`` characters.

    Only for callers that ask for a limit. ``spans`` are the entries to measure: the same ones, or
    only their spans and markers.
    """
    size = sizes(spans).filter(F.col("section") == KEYWORD).select("n_chars").scalar()
    return entry_rows.filter((F.col("section") != KEYWORD) | (size <= F.lit(max_chars)))


def sorted_listing(df: DataFrame, key: str) -> DataFrame:
    """All rows of a keyed table in the order of the key.

    The other columns break ties, so rows with the same key can go to different tasks.
    """
    return df.orderBy(key, *[name for name in df.columns if name != key])
