"""Column expressions of the log format. All of them are built-in Spark SQL functions.

"raw" is the text of one record with its lines joined by a line feed, as it stands in the file.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.catalogue import ASCII_WHITESPACE, HEADER, LEVELS, SEPARATOR, WHITESPACE

def _third_token(blank: str) -> str:
    token, gap = f"[^{blank}]++", f"[{blank}]++"
    return f"^{token}{gap}{token}{gap}({token})"


# Most lines have characters below 128 only, for which a smaller class of blanks does.
_THIRD_OF_ANY = _third_token(WHITESPACE)
_THIRD_OF_ASCII = _third_token(ASCII_WHITESPACE)


def let(value: Column, body) -> Column:
    """Bind ``value`` once: a lambda variable is never inlined into the places that use it."""
    return F.transform(F.array(value), body).getItem(0)


def is_header(line: Column) -> Column:
    return line.rlike(f"^{HEADER}")


def header_level(raw: Column) -> Column:
    """Third token of the first line; an empty string if that line is too short."""
    first_line = F.substring_index(raw, "\n", 1)
    return F.when(
        F.octet_length(first_line) == F.length(first_line), F.regexp_extract(first_line, _THIRD_OF_ASCII, 1)
    ).otherwise(F.regexp_extract(first_line, _THIRD_OF_ANY, 1))


def is_short_header(line: Column) -> Column:
    """A header with fewer than three tokens: its whole file yields no level output."""
    return is_header(line) & (header_level(line) == "")


def is_known(level: Column) -> Column:
    return level.isin(*LEVELS)


def joined(raw: Column) -> Column:
    """Record text: each line followed by the separator."""
    return F.concat(F.replace(raw, F.lit("\n"), F.lit(SEPARATOR)), F.lit(SEPARATOR))


def line_count(raw: Column) -> Column:
    breaks = F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit("")))
    return (breaks + 1).cast("long")


def parse_keywords(keywords: str | list[str], match: str | None = None) -> list[str]:
    """Comma list to the keywords that count.

    ``first``: only the first non-empty keyword has an effect. ``any``: all of them have. One of
    the two must be stated if there is more than one keyword, so none is left out unnoticed.
    Nothing is trimmed and nothing is lowercased.
    """
    if match not in (None, "first", "any"):
        raise ValueError(f"match must be 'first' or 'any', not {match!r}")
    parts = keywords.split(",") if isinstance(keywords, str) else list(keywords)
    parts = [part for part in parts if part != ""]
    if match is None and len(parts) > 1:
        raise ValueError(f"say match='any', or match='first' to leave out {parts[1:]}")
    return parts[:1] if match == "first" else parts


def any_keyword(text: Column, keywords: list[str]) -> Column:
    """Does the lowercased text contain one of the keywords? The keywords keep their case."""
    found = F.lit(False)
    for keyword in keywords:
        if "\n" not in keyword:  # a line never contains a line feed
            found = found | F.contains(F.lower(text), F.lit(keyword))
    return found


def keyword_span(raw: Column, keywords: list[str]) -> Column:
    """Lines of a record from the first matching line on.

    A matching line is followed by the separator, a later line without match by nothing.
    """

    def from_first_match(lines: Column) -> Column:
        return let(F.transform(lines, lambda line: any_keyword(line, keywords)), lambda hits: joined_tail(lines, hits))

    def joined_tail(lines: Column, hits: Column) -> Column:
        return let(F.array_position(hits, True).cast("int"), lambda first: text_from(lines, hits, first))

    def text_from(lines: Column, hits: Column, first: Column) -> Column:
        marked = F.zip_with(lines, hits, lambda line, hit: F.when(hit, F.concat(line, F.lit(SEPARATOR))).otherwise(line))
        return F.array_join(F.slice(marked, first, F.size(lines) - first + 1), "")

    return let(F.split(raw, "\n", -1), from_first_match)


def trim_first_tab(hit_no: Column, hit: Column) -> Column:
    """The first span of a file loses one leading tab."""

    def trimmed(span: Column) -> Column:
        is_first = (hit_no == 1) & F.startswith(span, F.lit("\t"))
        return F.when(is_first, F.substring(span, 2, 2**31 - 1)).otherwise(span)

    return let(hit, trimmed)


def now_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
