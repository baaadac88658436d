"""Triage of a log folder: the full report and the keyword-only report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.catalogue import MAX_KEYWORD_CHARS
from emberlog.functions.text import parse_keywords
from emberlog.operators import containers, patterns
from emberlog.plans import nested, report
from emberlog.sources.files import LogFiles


@dataclass(frozen=True)
class Triage:
    """Lazy results of one run. Each of them reads the files once, ``rows`` twice if it has a limit.

    With ``exclusive`` only the keywords are searched: level lists and buckets are empty. Nothing is
    left out for its size, unless ``max_keyword_chars`` sets a limit.
    """

    files: LogFiles
    keywords: tuple[str, ...]
    exclusive: bool = False
    max_keyword_chars: int | None = None

    def rows(self) -> DataFrame:
        """All sections as ``(section, pattern_no, container_id, ord, text)``.

        Keyword spans are left out if the caller set a limit and together they are over it.
        """
        entries = self._entries(list(self.keywords), levels=True)
        if self.keywords and self.max_keyword_chars is not None:
            spans = self._entries(list(self.keywords), levels=False)
            entries = containers.withheld(entries, spans, self.max_keyword_chars)
        return report.rows(entries)

    def nested(self, max_chars: int = nested.MAX_CHARS) -> DataFrame:
        """The report as one row for each container, in parts of at most ``max_chars`` characters; see ``plans.nested``."""
        limit = MAX_KEYWORD_CHARS if self.max_keyword_chars is None else self.max_keyword_chars
        entries = self._entries(list(self.keywords), levels=True)
        return nested.nested(entries, max_chars, limit, self.max_keyword_chars is not None, self.files.has_large, self.files.rows_per_chunk)

    def sizes(self) -> DataFrame:
        """``(section, n_items, n_chars, flag)`` for the level lists and the keyword lists."""
        limit = MAX_KEYWORD_CHARS if self.max_keyword_chars is None else self.max_keyword_chars
        return containers.sizes(self._entries(list(self.keywords), levels=True), {containers.KEYWORD: limit})

    def pattern_summary(self) -> DataFrame:
        """Hits per phrase, phrases without a hit included."""
        found = self._entries([], levels=True).select(
            "container_id", "ord", F.col("section").alias("level"), F.col("text").alias("record")
        )
        return patterns.summary(patterns.all_hits(found, order="ord"))

    def container_summary(self) -> DataFrame:
        """Counts per container in path order; a container without a kept record has zeros."""
        found = self._entries([], levels=True).select(
            "container_id", F.col("section").alias("level"), F.col("text").alias("record")
        )
        return containers.summary(found).orderBy("container_id")

    def quarantine(self) -> DataFrame:
        """Files left out of this report, with the reason."""
        found = self.files.quarantine()
        return found.filter(F.col("reason") != "short_header") if self.exclusive else found

    def write(self, path: str) -> None:
        """Write the report as JSON lines below ``path``.

        ``rows`` has a folder per section; ``nested`` an object for each container with all its lists; ``containers`` has every container that was read, also one
        without any result; ``patterns`` every phrase, also one without a hit; ``sizes`` and ``quarantine``.
        """
        report.write_json(self.rows(), f"{path}/rows")
        report.write_json(self.nested().withColumnRenamed("container_id", "filepath"), f"{path}/nested", None)
        parts = {"containers": self.container_summary(), "patterns": self.pattern_summary(), "sizes": self.sizes(), "quarantine": self.quarantine()}
        for name, part in parts.items():
            report.write_json(part, f"{path}/{name}", None)

    def _entries(self, keywords: list[str], levels: bool) -> DataFrame:
        return self.files.entries(keywords, levels and not self.exclusive, full=not self.exclusive)


def triage(
    spark: SparkSession,
    path: str,
    keyword: str = "",
    exclusive: bool = False,
    pattern: str | None = None,
    match: str | None = None,
    **limits: int,
) -> Triage:
    """Report over all log files below ``path``.

    ``keyword`` is a comma list; with several parts, ``match="any"`` takes all and ``match="first"``
    the first non-empty one. ``limits`` are the size limits of ``LogFiles``.
    """
    files = LogFiles(spark, path, **({"pattern": pattern} if pattern else {}), **limits)
    return Triage(files, tuple(parse_keywords(keyword, match)), exclusive)
