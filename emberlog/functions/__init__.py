from emberlog.functions.text import (
    any_keyword,
    header_level,
    is_header,
    is_short_header,
    joined,
    keyword_span,
    now_text,
    parse_keywords,
    trim_first_tab,
)

__all__ = [
    "any_keyword",
    "header_level",
    "is_header",
    "is_short_header",
    "joined",
    "keyword_span",
    "now_text",
    "parse_keywords",
    "trim_first_tab",
]
