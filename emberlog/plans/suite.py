"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.catalogue import CATALOGUE, MAX_KEYWORD_CHARS
from emberlog.functions.text import is_short_header, parse_keywords
from emberlog.operators import containers, keywords, patterns, records
from emberlog.operators.ordering import ROWS_PER_CHUNK, cut_large_groups
from emberlog.plans import nested, report
from emberlog.sources.files import has_short_header
from emberlog.sources.tables import (
    LINE_ORDER,
    documents_as_logs,
    documents_as_text,
    event_lines,
    line_positions,
    second_run,
    table,
)

SPAN_KEYWORDS = ("memorystore", "frame(")
RARE_KEYWORD = '{"k": 7}'
DOCUMENT_KEYWORD = "license"
SMALL_LIMIT = 1_000
TEXT_KEYWORD = "ation"
#: Characters in a part of the nested report, few enough for containers to have several.
PART_CHARS = 2_000


class LogView:
    """Log lines of ``events`` with everything derived from them, in one of two plans.

    ``chunk`` is set if the check found a container that is too large for one task.
    """

    def __init__(
        self,
        spark: SparkSession,
        sf_dir: str,
        damaged: bool = False,
        drop_short: bool = False,
        again: bool = False,
        rows_per_chunk: int = ROWS_PER_CHUNK,
    ):
        events = table(spark, sf_dir, "events")
        lines = event_lines(events, damaged)
        if again:
            lines = second_run(lines)
        if drop_short:
            lines = records.drop_short_header_lines(lines)
        self.rows_per_chunk = rows_per_chunk
        self.lines, self.is_cut = cut_large_groups(
            lines,
            "container_id",
            line_positions(),
            rows_per_chunk,
            at_most=2 * events.count(),  # answered from the footers of the files
        )
        self.chunk = "chunk" if self.is_cut else None

    def numbered(self) -> DataFrame:
        return records.number_lines(self.lines, LINE_ORDER, self.chunk)

    def pieces(self, *levels: str) -> DataFrame:
        return records.pieces_from_lines(self.lines, LINE_ORDER, self.chunk, levels)

    def records(self, *levels: str) -> DataFrame:
        return records.records(self.pieces(*levels))

    def segments(self) -> DataFrame:
        return records.merge_gaps(self.records(), self.is_cut, self.rows_per_chunk)

    def facts(self, keyword: str = "") -> DataFrame:
        return records.line_facts(self.lines, LINE_ORDER, self.chunk, parse_keywords(keyword))

    def merged_facts(self) -> DataFrame:
        facts = records.line_facts(self.lines, LINE_ORDER, self.chunk, hashes=True)
        return records.merged_facts(facts, self.is_cut, self.rows_per_chunk)

    def fingerprints(self) -> DataFrame:
        return containers.fingerprinted(self.merged_facts(), "seg", self.is_cut, self.rows_per_chunk, self.lines.select("container_id").distinct())

    def spans(self, keyword: str) -> DataFrame:
        return keywords.spans(self.pieces(), keyword, chunk=self.is_cut, rows_per_chunk=self.rows_per_chunk)

    def entries(self, keyword: str) -> DataFrame:
        ids = self.lines.select("container_id").distinct()
        return containers.entries(ids, self.segments(), self.spans(keyword))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


# --- lines and headers ----------------------------------------------------------------------


@registered
def log_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LogView(spark, sf_dir).numbered().select("container_id", "line_no", "line")


@registered
def header_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_record = F.col("rec_no") > 0
    return (
        LogView(spark, sf_dir)
        .facts()
        .groupBy("container_id")
        .agg(
            F.count_if(in_record).alias("n_header"),
            F.coalesce(F.sum(F.when(in_record, F.col("n_lines") - 1)), F.lit(0)).alias("n_continuation"),
            F.coalesce(F.sum(F.when(~in_record, F.col("n_lines"))), F.lit(0)).alias("n_prelude"),
        )
    )


@registered
def file_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(table(spark, sf_dir, "events"), damaged=True)
    return (
        lines.filter(is_short_header(F.col("line")))
        .groupBy("container_id")
        .agg(F.count("*").alias("n_short_headers"))
    )


# --- records --------------------------------------------------------------------------------


@registered
def record_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LogView(spark, sf_dir).records().filter(F.col("rec_no") > 0)


@registered
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = LogView(spark, sf_dir).facts().filter(F.col("rec_no") > 0)
    return facts.groupBy("level").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@registered
def error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = LogView(spark, sf_dir).records("ERROR")
    return records.of_level(recs, "ERROR").select("container_id", "rec_no", "record")


@registered
def warn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = LogView(spark, sf_dir).records("WARN")
    return records.of_level(recs, "WARN").select("container_id", "rec_no", "record")


@registered
def info_caused_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = LogView(spark, sf_dir).records("INFO")
    return records.of_level(recs, "INFO").select("container_id", "rec_no", "record")


@registered
def level_gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LogView(spark, sf_dir).segments()


# --- phrases --------------------------------------------------------------------------------


@registered
def error_pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.hits(LogView(spark, sf_dir).records("ERROR"), "ERROR").drop("kind")


@registered
def warn_pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.hits(LogView(spark, sf_dir).records("WARN"), "WARN").drop("kind")


@registered
def pattern_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.summary(patterns.hits_of_facts(LogView(spark, sf_dir).facts()))


@registered
def pattern_summary_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = LogView(spark, sf_dir)
    masks = [F.bit_or(name).alias(name) for name in (f"mask_{kind}" for kind in CATALOGUE)]
    merged = records.merge_gaps(view.facts(), view.is_cut, view.rows_per_chunk, masks)
    return patterns.summary(patterns.hits_of_facts(merged))


# --- containers -----------------------------------------------------------------------------


@registered
def container_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.summary_of_facts(LogView(spark, sf_dir).facts()).orderBy("container_id")


@registered
def container_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over containers of which some have changed: an entry with equal lists comes once."""
    first, second = LogView(spark, sf_dir), LogView(spark, sf_dir, again=True)
    both = containers.accumulate(first.fingerprints(), second.fingerprints())
    return both.select("container_id", "n_error", "n_warn", "n_info_kept")


@registered
def run_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the damaged logs, then one over the repaired logs; results of both stay."""
    first, second = LogView(spark, sf_dir, damaged=True, drop_short=True), LogView(spark, sf_dir)
    return containers.accumulate(first.fingerprints(), second.fingerprints()).select("container_id", "n_error", "n_warn")


@registered
def sorted_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_name", "c_mktsegment")
    return containers.sorted_listing(customers, "c_name")


# --- keywords -------------------------------------------------------------------------------


@registered
def keyword_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = LogView(spark, sf_dir)
    return keywords.spans_of_each(view.pieces(), list(SPAN_KEYWORDS), view.is_cut, view.rows_per_chunk)


@registered
def keyword_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.hits_per_container(LogView(spark, sf_dir).facts(RARE_KEYWORD))


@registered
def keyword_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-only mode does not look at levels, so files with a short header stay."""
    view = LogView(spark, sf_dir, damaged=True)
    return view.spans(SPAN_KEYWORDS[0]).select("container_id", "hit_no", "hit")


@registered
def keyword_spans_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents_as_text(table(spark, sf_dir, "documents"))
    spans = keywords.spans_from_text(texts, DOCUMENT_KEYWORD)
    return spans.select(F.col("container_id").alias("doc_id"), "hit", "n_match")


# --- report ---------------------------------------------------------------------------------


@registered
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rows(LogView(spark, sf_dir).entries(SPAN_KEYWORDS[1]))


@registered
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_json(containers.summary_of_facts(LogView(spark, sf_dir).facts()))


@registered
def report_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report by container, in parts of at most ``PART_CHARS`` characters."""
    view = LogView(spark, sf_dir)
    entries = view.entries(SPAN_KEYWORDS[1])
    return nested.flat(nested.nested(entries, PART_CHARS, chunk=view.is_cut, rows_per_chunk=view.rows_per_chunk))


@registered
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report as one JSON object for each container: lists, buckets and spans with all their texts."""
    view = LogView(spark, sf_dir)
    entries = view.entries(SPAN_KEYWORDS[0])
    return nested.documents(nested.nested(entries, chunk=view.is_cut, rows_per_chunk=view.rows_per_chunk))


@registered
def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over whole texts; spans are over a small limit and left out."""
    entries = containers.entries_from_text(document_logs(spark, sf_dir), [TEXT_KEYWORD])
    return nested.documents(nested.nested(entries, max_keyword_chars=SMALL_LIMIT, withhold=True))


@registered
def payload_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the level lists, and of the keyword spans with flags for the usual and a small limit."""
    view = LogView(spark, sf_dir)
    entries = containers.entry_sizes(view.merged_facts(), view.spans(SPAN_KEYWORDS[0]))
    return containers.sizes(entries, {"Keyword": MAX_KEYWORD_CHARS, "Keyword, small limit": SMALL_LIMIT})


# --- whole texts, one log per row -----------------------------------------------------------


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_logs(table(spark, sf_dir, "documents"))


@registered
def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = document_logs(spark, sf_dir).filter(~has_short_header(F.col("value")))
    return records.pieces_from_text(logs)


@registered
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.segments_from_text(document_logs(spark, sf_dir))


@registered
def text_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full report: level lists, phrase buckets and keyword spans."""
    return report.rows(containers.entries_from_text(document_logs(spark, sf_dir), [TEXT_KEYWORD]))


@registered
def text_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every container that was read, also of those without any kept record."""
    entries = containers.entries_from_text(document_logs(spark, sf_dir), [])
    return containers.summary(entries.select("container_id", F.col("section").alias("level"), F.col("text").alias("record")))


@registered
def text_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = document_logs(spark, sf_dir).filter(has_short_header(F.col("value")))
    return logs.select("container_id", F.lit("short_header").alias("reason"))


@registered
def text_keyword_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = keywords.spans_from_text(document_logs(spark, sf_dir), TEXT_KEYWORD)
    return spans.select("container_id", "hit_no", "hit", "n_match")


@registered
def keyword_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of several keywords in one pass."""
    spans = keywords.spans_from_text(document_logs(spark, sf_dir), [TEXT_KEYWORD, DOCUMENT_KEYWORD], "any")
    return spans.select("container_id", "hit_no", "hit", "n_match")
