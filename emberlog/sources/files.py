"""Log files: discovery, decompression, decoding, and the files that cannot be read.

A file is one container; its path is the identity. Most files are read as one whole text per row,
which keeps every line feed and carriage return and lets all work on a file stay in its row.
Files over a size limit are read as lines and numbered in chunks, so that no task holds such a
file in memory.

Files are listed by ``sources.walk``: hidden names and files of zero bytes as well, which Spark's readers pass over.
Large gzip and bzip2 files are read as streams that end with a status, so a damaged one costs that file only. Where
a path has a scheme that only Spark knows, Spark lists the files: hidden and empty ones are then missing, and a large
damaged file stops the job.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from emberlog.catalogue import ASCII_WHITESPACE, HEADER, WHITESPACE
from emberlog.functions.text import is_short_header, parse_keywords
from emberlog.operators import containers, keywords, records
from emberlog.operators.ordering import ROWS_PER_CHUNK
from emberlog.sources import walk

DEFAULT_PATTERN = "*stderr.gz"
COMPRESSED_NAME = r"\.(gz|bz2|zst|deflate|lz4|snappy)$"

# Bytes of text up to which a file is read as one value.
MAX_TEXT_BYTES = 512 * 1024 * 1024
MAX_PLAIN_BYTES = 64 * 1024 * 1024
# How much longer than the file its text can be at most, for formats that have such a bound.
EXPANSION = {"gz": 1032, "deflate": 1032, "lz4": 255, "snappy": 22}
BYTE_ORDER_MARK = "\ufeff"

END_OF_FILE = 2**63 - 1


def normalised_path(path: str) -> str:
    """Path without one trailing slash."""
    if path == "":
        raise ValueError("the log path is empty")
    return path[:-1] if path.endswith("/") else path


def application_path(root: str, cluster_id: str, application_id: str) -> str:
    """Folder of one application: ``<root>/<cluster>/containers/<application>``."""
    return f"{normalised_path(root)}/{cluster_id}/containers/{application_id}"


def with_path_columns(df: DataFrame) -> DataFrame:
    """Add ``cluster_id`` and ``application_id`` as found in the path, null where absent."""
    path = F.col("container_id")
    layout = r"/([^/]+)/containers/([^/]+)/"
    found = path.rlike(layout)
    return df.withColumns(
        {
            "cluster_id": F.when(found, F.regexp_extract(path, layout, 1)),
            "application_id": F.when(found, F.regexp_extract(path, layout, 2)),
        }
    )


def _container_id() -> Column:
    """Path as written by the user: percent codes resolved, no ``file:`` in front of local paths."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(encoded), "^file:/+", "/")


def _without_mark(value: Column) -> Column:
    return F.when(F.startswith(value, F.lit(BYTE_ORDER_MARK)), F.substring(value, 2, 2**31 - 1)).otherwise(value)


def has_short_header(value: Column) -> Column:
    """The test of ``is_short_header`` on any line of a whole text, in one scan."""
    # A line feed in front lets every header be found by the same plain start of the pattern.
    lines = F.concat(F.lit("\n"), value)

    def found(blank: str) -> Column:
        token, gap = f"[^{blank}]++", f"[{blank}&&[^\\n]]++"
        return lines.rlike(rf"\n(?={HEADER}){token}(?:{gap}{token})?(?:{gap})?(?:\n|\z)")

    is_ascii = F.octet_length(value) == F.length(value)
    return F.when(is_ascii, found(ASCII_WHITESPACE)).otherwise(found(WHITESPACE))


@dataclass(frozen=True)
class LogFiles:
    """All log files below a path.

    ``full`` views leave out files with a header of fewer than three tokens, the keyword view
    does not. Unreadable files and files that are not UTF-8 are in neither; see ``quarantine``.
    A byte order mark at the start of a file is dropped.

    A compressed file is read as one text only if its format bounds what it can grow to, so that
    no text is longer than ``max_text_bytes``; all other files are read as lines.

    ``cluster_id`` and ``application_id`` take the files of one cluster or application of the layout
    ``<path>/<cluster>/containers/<application>``; no other folder is listed.
    """

    spark: SparkSession
    path: str
    pattern: str = DEFAULT_PATTERN
    max_text_bytes: int = MAX_TEXT_BYTES
    max_plain_bytes: int = MAX_PLAIN_BYTES
    rows_per_chunk: int = ROWS_PER_CHUNK
    cluster_id: str | None = None
    application_id: str | None = None

    # --- discovery --------------------------------------------------------------------------

    def _reader(self) -> DataFrameReader:
        return self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", self.pattern)

    @property
    def root(self) -> str:
        """What Spark's readers list: the path, or the folders of a cluster or application below it."""
        path = normalised_path(self.path)
        if self.cluster_id is None and self.application_id is None:
            return path
        return application_path(path, self.cluster_id or "*", self.application_id or "*")

    def _is_large(self, name: Column, size: Column) -> Column:
        """Uses only what the file listing knows, so files are left out before they are opened."""
        limit = F.when(~name.rlike(COMPRESSED_NAME), F.lit(self.max_plain_bytes))
        for ending, factor in EXPANSION.items():
            limit = limit.when(name.endswith(f".{ending}"), F.lit(self.max_text_bytes // factor))
        return size > limit.otherwise(F.lit(-1))

    def _read_large(self) -> Column:
        """``_is_large`` for rows of Spark's readers."""
        return self._is_large(F.col("_metadata.file_name"), F.col("_metadata.file_size"))

    # Folders are listed once per kind of reader and object.

    @cached_property
    def _opened(self) -> bool:
        """Whether files can be opened outside of Spark's readers."""
        return walk.walkable(normalised_path(self.path))

    @property
    def _walked(self) -> bool:
        """Spark resolves paths with wildcards, and then lists them."""
        return self._opened and not any(c in self.path for c in "*?[{")

    @cached_property
    def _listing(self) -> DataFrame:
        """``path, n_bytes, how``: ``empty``, ``hidden``, ``small``, ``large`` or ``streamed``."""
        if self._walked:
            files = walk.walk(self.spark, normalised_path(self.path), self.pattern)
            for name in ("cluster_id", "application_id"):
                if (value := getattr(self, name)) is not None:
                    files = files.filter(F.col(name) == value)
        else:
            found = self._reader().format("binaryFile").load(self.root)
            files = found.select(_container_id().alias("path"), F.col("_metadata.file_name").alias("name"), F.col("length").alias("n_bytes"), F.lit(False).alias("hidden"))
        large, hidden = self._is_large(F.col("name"), F.col("n_bytes")), F.col("hidden")
        streamed = large & (hidden | walk.is_streamed(F.col("name"))) & F.lit(self._opened)
        how = F.when(F.col("n_bytes") == 0, "empty").when(streamed, "streamed").when(large, "large").when(hidden, "hidden").otherwise("small")
        return files.select("path", "n_bytes", how.alias("how"))

    @cached_property
    def _kinds(self) -> set[str]:
        return {row["how"] for row in self._listing.select("how").distinct().collect()}

    def _listed_as(self, how: str) -> DataFrame:
        return self._listing.filter(F.col("how") == how).select("path")

    @cached_property
    def _whole_texts(self) -> DataFrame:
        reader = self._reader().option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        return reader.text(self.root, wholetext=True)

    @cached_property
    def _lines(self) -> DataFrame:
        return self._reader().option("lineSep", "\n").text(self.root)

    @cached_property
    def _words(self) -> DataFrame:
        return self._reader().option("lineSep", " ").text(self.root)

    def listed(self) -> DataFrame:
        """``(container_id, n_bytes)`` of every file, without reading any."""
        return self._listing.select(F.col("path").alias("container_id"), "n_bytes")

    @property
    def has_large(self) -> bool:
        return bool({"large", "streamed"} & self._kinds)

    # --- whole texts ------------------------------------------------------------------------

    def _decompressed(self) -> DataFrame:
        """``(container_id, value)`` of readable files up to the limit. Bytes may be invalid."""
        small = self._whole_texts.filter(~self._read_large() & (F.col("_metadata.file_size") > 0))
        found = small.select(_container_id().alias("container_id"), F.col("value"))
        if "hidden" in self._kinds:
            found = found.unionByName(walk.whole(self._listed_as("hidden")).filter(F.col("value").isNotNull()).withColumnRenamed("path", "container_id"))
        if "empty" in self._kinds:
            found = found.unionByName(self._listed_as("empty").select(F.col("path").alias("container_id"), F.lit("").alias("value")))
        return found.select("container_id", _without_mark(F.col("value")).alias("value"))

    def texts(self, full: bool = True) -> DataFrame:
        valid = self._decompressed().filter(F.is_valid_utf8("value"))
        return valid.filter(~has_short_header(F.col("value"))) if full else valid

    def stream_of_texts(self) -> DataFrame:
        """``(container_id, value, reason)`` as a stream of new files.

        The value is null and the reason given for files that a batch run would read as lines or
        leave out; they are not lost, as a run of ``triage`` over their paths has them.
        """
        reason = F.when(self._read_large(), "too_large").when(~F.is_valid_utf8("value"), "invalid_utf8")
        reason = reason.when(has_short_header(F.col("value")), "short_header")
        files = (
            self.spark.readStream.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", self.pattern)
            .option("ignoreCorruptFiles", "true")
            .option("ignoreMissingFiles", "true")
            .text(self.root, wholetext=True)
            .select(
                _container_id().alias("container_id"),
                _without_mark(F.col("value")).alias("value"),
                reason.alias("reason"),
            )
        )
        return files.withColumn("value", F.when(F.col("reason").isNull(), F.col("value")))

    # --- lines of large files ---------------------------------------------------------------

    def _large(self, cut: DataFrame) -> DataFrame:
        """Cut text of large files, with an order inside each file.

        Tasks get files or blocks of files, and number their rows in reading order.
        """
        mine = self._read_large()
        if self._opened:
            mine = mine & ~walk.is_streamed(F.col("_metadata.file_name"))
        return cut.filter(mine).select(
            _container_id().alias("container_id"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            F.col("value").alias("line"),
        )

    def _streamed(self) -> DataFrame:
        """The same of large compressed files, each read by one task, with ``status`` in the last row of a file."""
        lines = walk.streamed(self._listed_as("streamed"))
        return lines.select(F.col("path").alias("container_id"), F.lit(0).cast("long").alias("block"), "row", "line", "status")

    @cached_property
    def _large_file_facts(self) -> DataFrame:
        """Per large file: readable, valid UTF-8, short header, and whether a last empty line has to be added.

        A reader drops a separator at the end of a file. Cut at line feeds, the pieces with one
        byte for each separator are as long as the file if it ends with a line feed, and one byte
        longer if not; the same holds for blanks. So the line feed is there if and only if the
        first sum is the smaller one. Streams have that line already.
        """
        size = F.sum(F.octet_length("line") + 1)
        line = F.col("line")
        tests = [F.bool_and(F.is_valid_utf8("line")).alias("valid"), F.bool_or(is_short_header(line)).alias("short")]
        by_line = self._large(self._lines).groupBy("container_id").agg(size.alias("by_line"), *tests)
        by_blank = self._large(self._words).groupBy("container_id").agg(size.alias("by_blank"))
        facts = by_line.join(by_blank, "container_id").select(
            "container_id", F.lit(True).alias("readable"), "valid", "short", (F.col("by_line") < F.col("by_blank")).alias("ends_line")
        )
        if "streamed" in self._kinds:
            streamed = self._streamed().groupBy("container_id").agg((F.max("status") == walk.OK).alias("readable"), *tests)
            streamed = streamed.select(
                "container_id", "readable", F.coalesce("valid", F.lit(True)).alias("valid"), F.coalesce("short", F.lit(False)).alias("short"), F.lit(False).alias("ends_line")
            )
            facts = facts.unionByName(streamed) if "large" in self._kinds else streamed
        return durable(facts)

    def large_lines(self, full: bool = True) -> DataFrame:
        """``(container_id, block, row, chunk, line)`` of large files, with the last empty line."""
        facts = self._large_file_facts
        bad = ~F.col("readable") | ~F.col("valid")
        left_out = facts.filter(bad | F.col("short") if full else bad)
        last = facts.filter("ends_line").select(
            "container_id",
            F.lit(END_OF_FILE).alias("block"),
            F.lit(0).cast("long").alias("row"),
            F.lit("").alias("line"),
        )
        lines = last
        if "large" in self._kinds:
            lines = lines.unionByName(self._large(self._lines))
        if "streamed" in self._kinds:
            lines = lines.unionByName(self._streamed().filter(F.col("status").isNull()).drop("status"))
        part = F.floor(F.col("row") / self.rows_per_chunk).cast("long")
        return lines.join(left_out, "container_id", "left_anti").select(
            "container_id", "block", "row", F.array("block", part).alias("chunk"), "line"
        )

    # --- results over both kinds of files ---------------------------------------------------

    def entries(self, wanted: list[str], levels: bool = True, full: bool = True) -> DataFrame:
        """All results of all files, see ``operators.containers``; small files in one narrow pass."""
        # With levels, short headers are seen in the same pass.
        small = containers.entries_from_text(self.texts(full and not levels), wanted, levels)
        if not self.has_large:
            return small
        pieces = self._large_pieces(full)
        segments = self._large_segments(pieces) if levels else None
        spans = self._large_spans(pieces, wanted) if wanted else None
        return small.unionByName(containers.entries(self._large_ids(full), segments, spans))

    def pieces(self, full: bool = True) -> DataFrame:
        """Raw records ``(container_id, rec_no, level, raw)``."""
        small = records.pieces_from_text(self.texts(full))
        return small.unionByName(self._large_pieces(full)) if self.has_large else small

    def segments(self) -> DataFrame:
        """Merged records ``(container_id, seg, level, record)``."""
        small = records.segments_from_text(self.texts(full=False))
        return small.unionByName(self._large_segments(self._large_pieces(True))) if self.has_large else small

    def spans(self, keyword: str | list[str], match: str | None = None, full: bool = True) -> DataFrame:
        """Keyword spans ``(container_id, hit_no, hit, n_match)``."""
        wanted = parse_keywords(keyword, match)
        small = keywords.spans_from_text(self.texts(full), wanted, "any")
        return small.unionByName(self._large_spans(self._large_pieces(full), wanted)) if self.has_large else small

    def _large_pieces(self, full: bool) -> DataFrame:
        return records.pieces_from_lines(self.large_lines(full), ("block", "row"), "chunk")

    def _large_segments(self, pieces: DataFrame) -> DataFrame:
        return records.merge_gaps(records.records(pieces), True, self.rows_per_chunk)

    def _large_spans(self, pieces: DataFrame, wanted: list[str]) -> DataFrame:
        return keywords.spans(pieces, wanted, "any", True, self.rows_per_chunk)

    def _large_ids(self, full: bool) -> DataFrame:
        good = F.col("readable") & F.col("valid")
        good = good & ~F.col("short") if full else good
        return self._large_file_facts.filter(good).select("container_id")

    def containers(self, full: bool = True) -> DataFrame:
        """``container_id`` of every file that gives a result."""
        small = self.texts(full).select("container_id")
        return small.unionByName(self._large_ids(full)) if self.has_large else small

    def quarantine(self) -> DataFrame:
        """``(container_id, reason)`` of files that are left out of a full result.

        ``short_header`` files still take part in keyword-only results.
        """
        value = F.col("value")
        reason = F.when(~F.is_valid_utf8(value), "invalid_utf8").when(has_short_header(value), "short_header")
        read = self._decompressed().select("container_id", reason.alias("reason"))
        if self.has_large:
            why = F.when(~F.col("readable"), "unreadable").when(~F.col("valid"), "invalid_utf8").when(F.col("short"), "short_header")
            read = read.unionByName(self._large_file_facts.select("container_id", why.alias("reason")))
        # One row per file on both sides.
        return (
            self.listed()
            .select("container_id")
            .join(read.withColumn("was_read", F.lit(True)), "container_id", "left")
            .select("container_id", F.when(F.col("was_read"), F.col("reason")).otherwise("unreadable").alias("reason"))
            .filter(F.col("reason").isNotNull())
        )


def durable(df: DataFrame) -> DataFrame:
    """Write a result to the shared checkpoint folder of the session and go on from there."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return df.checkpoint()
