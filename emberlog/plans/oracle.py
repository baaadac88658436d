"""The same queries as SQL over the same tables, for the correctness check."""

from __future__ import annotations

from emberlog.catalogue import CATALOGUE
from emberlog.plans.nested import MAX_CHARS
from emberlog.plans.suite import DOCUMENT_KEYWORD, PART_CHARS, RARE_KEYWORD, SMALL_LIMIT, SPAN_KEYWORDS, TEXT_KEYWORD

HEADER_TEST = "regexp_matches(line, '^([0-9]{2}/[0-9]{2}/[0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2})')"
SEP = "(' ' || chr(9) || ' ')"
KNOWN = "('ERROR', 'WARN', 'INFO')"
KEPT = "(level in ('ERROR', 'WARN') or (level = 'INFO' and contains(record, 'Caused by:')))"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lines(damaged: bool = False, name: str = "log_lines") -> str:
    short = "when event_id % 997 = 0 then strftime(ts, '%y/%m/%d %H:%M:%S')" if damaged else ""
    return f"""{name} as (
  select user_id as container_id,
    row_number() over (partition by user_id order by ts, event_id) as line_no,
    case when event_type = 'click'
         then chr(9) || 'at frame(' || event_id || ')' || case when event_id % 3 = 0 then ' Caused by: x' else '' end
         {short}
         else strftime(ts, '%y/%m/%d %H:%M:%S') || ' '
              || case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' when 'view' then 'INFO'
                 else 'DEBUG' end
              || ' ' || case event_id % 5 when 0 then 'Executor' when 1 then 'TaskSetManager' when 2 then 'Utils'
                        when 3 then 'MemoryStore' else 'YarnAllocator: Container from a bad node' end
              || ': ' || props end as line
  from events)"""


def numbered(source: str = "log_lines", name: str = "numbered") -> str:
    return f"""{name} as (
  select container_id, line_no, line, hdr,
    cast(sum(cast(hdr as int)) over (partition by container_id order by line_no) as bigint) as rec_no
  from (select *, {HEADER_TEST} as hdr from {source}))"""


def assembled(source: str = "numbered", name: str = "recs") -> str:
    return f"""{name} as (
  select container_id, rec_no, max(case when hdr then split_part(line, ' ', 3) end) as level,
    count(*) as n_lines, string_agg(line || {SEP}, '' order by line_no) as record
  from {source} group by container_id, rec_no)"""


def merged_segments(recs: str = "recs", tag: str = "") -> str:
    return f"""prevs{tag} as (
  select *, lag(level) over w as prev_any,
    last_value(case when level in {KNOWN} then level end ignore nulls)
      over (partition by container_id order by rec_no rows between unbounded preceding and 1 preceding) as prev_known,
    last_value(level) over (partition by container_id order by rec_no
      rows between unbounded preceding and unbounded following) as final_level
  from {recs} where rec_no > 0 window w as (partition by container_id order by rec_no)),
marked{tag} as (
  select *, cast(sum(case when coalesce(level = prev_known and prev_any not in {KNOWN}, false) then 0 else 1 end)
    over (partition by container_id order by rec_no) as bigint) as seg
  from prevs{tag} where level in {KNOWN}),
counted{tag} as (select *, max(seg) over (partition by container_id) as last_seg from marked{tag}),
segs{tag} as (
  select container_id, seg, max(level) as level, string_agg(record, '' order by rec_no) as record
  from counted{tag} where final_level in {KNOWN} or seg < last_seg group by container_id, seg)"""

RECORDS = f"with {lines()},\n{numbered()},\n{assembled()}"
SEGMENTS = merged_segments()
MERGED = f"{RECORDS},\n{SEGMENTS}"


def phrases(kind: str) -> str:
    values = ", ".join(f"('{kind}', {no}, {text(p)})" for no, p in enumerate(CATALOGUE[kind]))
    return f"values {values}"


PHRASES = f"phrases(kind, pattern_no, pattern) as ({phrases('ERROR')} union all {phrases('WARN')})"


def spans(keyword: str, source: str = "numbered", name: str = "spans") -> str:
    return f"""{name}_m as (
  select *, contains(lower(line), {text(keyword)}) as m,
    max(cast(contains(lower(line), {text(keyword)}) as int))
      over (partition by container_id, rec_no order by line_no) as started
  from {source}),
{name}_r as (
  select container_id, rec_no, string_agg(line || case when m then {SEP} else '' end, '' order by line_no) as hit,
    count(*) filter (where m) as n_match
  from {name}_m where started = 1 group by container_id, rec_no),
{name}_n as (select *, row_number() over (partition by container_id order by rec_no) as hit_no from {name}_r),
{name} as (
  select container_id, hit_no,
    case when hit_no = 1 and starts_with(hit, chr(9)) then substr(hit, 2) else hit end as hit, n_match
  from {name}_n)"""


def hit_rows(kind: str) -> str:
    return f"""{RECORDS}, {PHRASES}
select cast(pattern_no as bigint) as pattern_no, pattern, container_id, rec_no, record
from recs join phrases on kind = '{kind}' and level = kind and contains(record, pattern)"""


def phrase_summary(prefix: str, source: str) -> str:
    return f"""{prefix}, {PHRASES},
hit as (select kind, pattern_no, container_id from {source} join phrases on level = kind and contains(record, pattern))
select p.kind, cast(p.pattern_no as bigint) as pattern_no, p.pattern, count(h.container_id) as n_records,
  count(distinct h.container_id) as n_containers
from phrases p left join hit h on p.kind = h.kind and p.pattern_no = h.pattern_no
group by p.kind, p.pattern_no, p.pattern"""


def container_counts(source: str = "recs") -> str:
    return f"""select container_id, count(*) filter (where level = 'ERROR') as n_error,
  count(*) filter (where level = 'WARN') as n_warn,
  count(*) filter (where level = 'INFO' and {KEPT}) as n_info_kept,
  cast(coalesce(sum(length(record)) filter (where {KEPT}), 0) as bigint) as n_chars
from {source} group by container_id"""


def with_lists(source: str) -> str:
    def one(level: str) -> str:
        return f"list(record order by seg) filter (where level = '{level}' and {KEPT})"

    return f"""select container_id, {one('ERROR')} as errors, {one('WARN')} as warns, {one('INFO')} as infos
from {source} group by container_id"""


def all_lists(source: str, recs: str) -> str:
    """The lists of every container, also of those without a segment."""
    return f"""select container_id, errors, warns, infos from (select distinct container_id from {recs})
left join ({with_lists(source)}) using (container_id)"""


#: Lines of a later run, see ``sources.tables.second_run``.
SECOND = f"""{lines(name='base_lines')},
kept_lines as (
  select l.* from base_lines l where not (container_id % 3 = 1 and split_part(line, ' ', 3) = 'WARN' and {HEADER_TEST})
  union all select distinct container_id, 0, '70/01/01 00:00:00 DEBUG Utils: start' from base_lines where container_id % 2 = 0),
again_lines as (
  select case when container_id % 5 = 4 then container_id + 1000000 else container_id end as container_id, line_no, line from kept_lines)"""

#: Documents as logs, see ``sources.tables.documents_as_logs``.
LOGS = f"""cut as (select doc_id as container_id, string_split(text, chr(10)) as parts from documents),
parts as (select container_id, unnest(range(1, len(parts) + 1)) as line_no, unnest(parts) as part from cut),
all_lines as (
  select container_id, line_no, case when container_id % 50 = 7 and line_no = 2 then '20/06/06' else coalesce(
    '2020-06-06 22:25:17 ' || case when (line_no - 1) % 5 = 1 then 'ERROR'
      when (line_no - 1) % 5 = 2 then case when (line_no - 1) % 10 = 2 then 'DEBUG' else 'ERROR' end
      when (line_no - 1) % 7 = 4 then 'WARN' when (line_no - 1) % 7 = 5 then 'INFO' end
    || case when (line_no - 1) % 3 = 0 then ' Caused by: ' else ' Executor: ' end || part, part) end as line
  from parts),
short as (select distinct container_id from all_lines where line = '20/06/06'),
log_lines as (select * from all_lines where container_id not in (select container_id from short))"""


def text_spans(test: str) -> str:
    return spans(TEXT_KEYWORD).replace(f"contains(lower(line), {text(TEXT_KEYWORD)})", test)


def nested_rows(ids: str, max_chars: int, limit: int = 135_000_000, withhold: bool = False) -> str:
    """Nested report: ``segs``, ``spans`` and ``phrases`` are given. All nested values are JSON texts with sorted keys."""

    def one(section: str) -> str:
        return f"coalesce(cast(to_json(list(text order by ord) filter (where section = '{section}')) as varchar), '[]')"

    def bucket(section: str) -> str:
        return f"""'{{' || coalesce((select string_agg(cast(to_json(pattern) as varchar) || ':' || texts, ',' order by pattern) from (
    select pattern, cast(to_json(list(text order by ord)) as varchar) as texts from cut_up c
    join phrases p on c.pattern_no = p.pattern_no and p.kind = '{'ERROR' if section == 'SpecificError' else 'WARN'}'
    where c.container_id = n.container_id and c.part_no = n.part_no and section = '{section}' group by pattern)), '') || '}}'"""

    return f"""all_entries as (
  select container_id, 'container' as section, -1 as pattern_no, 0 as ord, '' as text from {ids}
  union all select container_id, level, -1, seg, record from segs where {KEPT}
  union all select container_id, case kind when 'ERROR' then 'SpecificError' else 'SpecificWarn' end, pattern_no, seg, record
    from segs join phrases on level = kind and contains(record, pattern)
  union all select container_id, 'Keyword', -1, hit_no, hit from spans),
sizes as (
  select cast(coalesce(sum(length(text)) filter (where section in {KNOWN}), 0) as bigint) as res_len,
    cast(coalesce(sum(length(text)) filter (where section = 'Keyword'), 0) as bigint) as all_len from all_entries),
own_size as (select res_len, all_len, cast(all_len > {limit} as int) as flag from sizes),
left_in as (select a.* from all_entries a, own_size where not ({withhold} and flag = 1 and section = 'Keyword')),
widths as (select greatest({max_chars} - max(length(text) + 1), 1) as width from left_in),
cut_up as (
  select l.*, cast((sum(length(text) + 1) over (partition by container_id order by section, pattern_no, ord) - length(text) - 1) // width as bigint) as part_no
  from left_in l, widths),
n as (
  select container_id, part_no, '{{"ERROR":' || {one('ERROR')} || ',"INFO":' || {one('INFO')} || ',"WARN":' || {one('WARN')} || '}}' as res, {one('Keyword')} as kw
  from cut_up group by container_id, part_no),
nested as (
  select container_id, part_no, res, {bucket('SpecificError')} as "SpecificError", {bucket('SpecificWarn')} as "SpecificWarn", kw as "Keyword", res_len as "resLen",
    case when {withhold} and flag = 1 then 0 else all_len end as "KeywordLen", flag
  from n, own_size)"""


DOCUMENT = """select container_id, part_no, '{"Keyword":' || "Keyword" || ',"KeywordLen":' || "KeywordLen" || ',"SpecificError":' || "SpecificError"
  || ',"SpecificWarn":' || "SpecificWarn" || ',"container_id":' || container_id || ',"flag":' || flag || ',"part_no":' || part_no
  || ',"res":' || res || ',"resLen":' || "resLen" || '}' as json from nested"""

IDS = "(select distinct container_id from log_lines)"


ORACLE: dict[str, str] = {
    "log_line_scan": f"with {lines()} select container_id, line_no, line from log_lines",
    "header_flag": f"""with {lines()}, {numbered()}
select container_id, count(*) filter (where hdr) as n_header,
  count(*) filter (where rec_no > 0 and not hdr) as n_continuation,
  count(*) filter (where rec_no = 0) as n_prelude
from numbered group by container_id""",
    "file_quarantine": f"""with {lines(damaged=True)}
select container_id, count(*) as n_short_headers from log_lines
where {HEADER_TEST} and len(string_split(line, ' ')) < 3 group by container_id""",
    "record_assembly": f"{RECORDS} select container_id, rec_no, level, n_lines, record from recs where rec_no > 0",
    "level_counts": f"""{RECORDS} select level, count(*) as n, cast(sum(length(record)) as bigint) as n_chars
from recs where rec_no > 0 group by level""",
    "error_records": f"{RECORDS} select container_id, rec_no, record from recs where level = 'ERROR'",
    "warn_records": f"{RECORDS} select container_id, rec_no, record from recs where level = 'WARN'",
    "info_caused_by": f"""{RECORDS} select container_id, rec_no, record from recs
where level = 'INFO' and contains(record, 'Caused by:')""",
    "level_gap_merge": f"{MERGED} select container_id, seg, level, record from segs",
    "error_pattern_hits": hit_rows("ERROR"),
    "warn_pattern_hits": hit_rows("WARN"),
    "pattern_summary": phrase_summary(RECORDS, "recs"),
    "pattern_summary_merged": phrase_summary(MERGED, "segs"),
    "container_summary": f"{RECORDS} {container_counts()} order by container_id",
    "container_dedup": f"""{MERGED}, {SECOND},
{numbered('again_lines', 'numbered_2')}, {assembled('numbered_2', 'recs_2')}, {merged_segments('recs_2', '_2')},
entries as ({all_lists('segs', 'recs')} union {all_lists('segs_2', 'recs_2')})
select container_id, cast(coalesce(len(errors), 0) as bigint) as n_error,
  cast(coalesce(len(warns), 0) as bigint) as n_warn, cast(coalesce(len(infos), 0) as bigint) as n_info_kept
from entries""",
    "run_accumulate": f"""with {lines()}, {lines(damaged=True, name='damaged_lines')},
readable as (select * from damaged_lines where container_id not in (
  select container_id from damaged_lines where {HEADER_TEST} and len(string_split(line, ' ')) < 3)),
{numbered()}, {numbered('readable', 'numbered_1')}, {assembled()}, {assembled('numbered_1', 'recs_1')},
{SEGMENTS}, {merged_segments('recs_1', '_1')},
entries as ({all_lists('segs_1', 'recs_1')} union {all_lists('segs', 'recs')})
select container_id, cast(coalesce(len(errors), 0) as bigint) as n_error,
  cast(coalesce(len(warns), 0) as bigint) as n_warn from entries""",
    "sorted_listing": "select c_name, c_mktsegment from customer order by c_name",
    "keyword_spans": f"""with {lines()}, {numbered()}, {spans(SPAN_KEYWORDS[0], name='a')},
{spans(SPAN_KEYWORDS[1], name='b')}
select {text(SPAN_KEYWORDS[0])} as keyword, container_id, hit_no, hit from a
union all select {text(SPAN_KEYWORDS[1])} as keyword, container_id, hit_no, hit from b""",
    "keyword_container": f"""with {lines()}, {numbered()}, {spans(RARE_KEYWORD)}
select l.container_id, count(s.hit_no) as n_hits
from (select distinct container_id from log_lines) l left join spans s on l.container_id = s.container_id
group by l.container_id""",
    "keyword_only": f"""with {lines(damaged=True)}, {numbered()}, {spans(SPAN_KEYWORDS[0])}
select container_id, hit_no, hit from spans""",
    "keyword_spans_docs": f"""with cut as (select doc_id as container_id, string_split(text, chr(10)) as parts from documents),
log_lines as (select container_id, unnest(range(1, len(parts) + 1)) as line_no, unnest(parts) as line from cut),
{numbered()}, {spans(DOCUMENT_KEYWORD)}
select container_id as doc_id, hit, n_match from spans""",
    "report_rows": f"""{MERGED}, {PHRASES}, {spans(SPAN_KEYWORDS[1])}
select level as section, cast(null as bigint) as pattern_no, container_id, seg as ord, record as text
from segs where {KEPT}
union all
select case kind when 'ERROR' then 'SpecificError' else 'SpecificWarn' end, cast(pattern_no as bigint),
  container_id, seg, record
from segs join phrases on level = kind and contains(record, pattern)
union all
select 'Keyword', null, container_id, hit_no, hit from spans""",
    "report_json": f"""{RECORDS}, counts as ({container_counts()})
select container_id, '{{"container_id":' || container_id || ',"n_chars":' || n_chars || ',"n_error":' || n_error
  || ',"n_info_kept":' || n_info_kept || ',"n_warn":' || n_warn || '}}' as json from counts""",
    "report_nested": f"""{MERGED}, {PHRASES}, {spans(SPAN_KEYWORDS[1])},
{nested_rows(IDS, PART_CHARS)} select * from nested""",
    "report_documents": f"""{MERGED}, {PHRASES}, {spans(SPAN_KEYWORDS[0])},
{nested_rows(IDS, MAX_CHARS)} {DOCUMENT}""",
    "text_documents": f"""with {LOGS}, {numbered()}, {assembled()}, {SEGMENTS}, {PHRASES}, {spans(TEXT_KEYWORD)},
{nested_rows(IDS, MAX_CHARS, SMALL_LIMIT, True)} {DOCUMENT}""",
    "payload_guard": f"""{MERGED}, {spans(SPAN_KEYWORDS[0])},
kw as (select count(*) as n_items, coalesce(sum(length(hit)), 0) as n_chars from spans),
res as (select count(*) as n_items, coalesce(sum(length(record)), 0) as n_chars from segs where {KEPT})
select 'Keyword' as section, n_items, cast(n_chars as bigint) as n_chars, cast(n_chars > 135000000 as bigint) as flag from kw
union all select 'Keyword, small limit', n_items, cast(n_chars as bigint), cast(n_chars > {SMALL_LIMIT} as bigint) from kw
union all select 'res', n_items, cast(n_chars as bigint), 0 from res""",
    "text_pieces": f"""with {LOGS}, {numbered()}
select container_id, rec_no, max(case when hdr then split_part(line, ' ', 3) end) as level, string_agg(line, chr(10) order by line_no) as raw
from numbered group by container_id, rec_no""",
    "text_segments": f"with {LOGS}, {numbered()}, {assembled()}, {SEGMENTS} select container_id, seg, level, record from segs",
    "text_entries": f"""with {LOGS}, {numbered()}, {assembled()}, {SEGMENTS}, {PHRASES}, {spans(TEXT_KEYWORD)}
select level as section, cast(null as bigint) as pattern_no, container_id, seg as ord, record as text from segs where {KEPT}
union all
select case kind when 'ERROR' then 'SpecificError' else 'SpecificWarn' end, cast(pattern_no as bigint), container_id, seg, record
from segs join phrases on level = kind and contains(record, pattern)
union all select 'Keyword', null, container_id, hit_no, hit from spans""",
    "text_containers": f"""with {LOGS}, {numbered()}, {assembled()}, {SEGMENTS},
counts as ({container_counts('segs')})
select container_id, coalesce(n_error, 0) as n_error, coalesce(n_warn, 0) as n_warn, coalesce(n_info_kept, 0) as n_info_kept,
  cast(coalesce(n_chars, 0) as bigint) as n_chars
from (select distinct container_id from log_lines) left join counts using (container_id)""",
    "text_quarantine": f"with {LOGS} select container_id, 'short_header' as reason from short",
    "text_keyword_only": f"""with {LOGS}, {numbered('all_lines')}, {spans(TEXT_KEYWORD)}
select container_id, hit_no, hit, n_match from spans""",
    "keyword_any": f"""with {LOGS}, {numbered('all_lines')},
{text_spans(f"(contains(lower(line), {text(TEXT_KEYWORD)}) or contains(lower(line), {text(DOCUMENT_KEYWORD)}))")}
select container_id, hit_no, hit, n_match from spans""",
}
