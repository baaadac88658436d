"""Recurring lines and sentences, found as log templates.

A text is cut into segments: its lines, and these after each sentence end that is followed by a blank, so a passage that
recurs inside of longer lines is found as well. A segment that is only a part of its line takes part with ``LONG`` tokens
or more. A token with a digit is a variable field from the start, and a segment needs ``CONSTANT`` of its tokens to be
none.

Segments are parsed by a tree of fixed depth: by the number of tokens, then by the first ``LEADING`` tokens. In a leaf
each document has one vote, divided among its segments there. The word with most votes at a place is the constant there if
it has half of all; the place is a variable field for every segment of the leaf if none has. The leaf's template is its
constants, if they are ``CONSTANT`` of all places. A segment that agrees with ``AGREE`` of them belongs to it, also one
with a word edited; any other is a template of its own. A template recurs if ``MIN_DOCS`` documents have it, or two for templates of ``LONG`` tokens or more, which do not come about by
chance. The document with the smallest identifier keeps its segments of the template, all others lose them.

Documents are told apart by their texts: exact copies count as one, keep or lose the same segments, and stay copies.

All is DataFrame functions, and one plan for all sizes: texts are parsed once, into a table of segments in the shared
folder, and what is found out is joined by the hash of the text. So texts are shuffled once, and before that only hashes of
segments and the segments of leaves that have several kinds. Bitmaps of fixed size sift the table, so only segments that
may be looked for are shuffled again. A segment in a third of all documents is counted by document
first and then added up, and joins by segment or text may be split by Spark, as one of their sides has a row for each.

Defined cases: a null text stays null and has no segments; blank ones have no template and stay; a line that loses all
its segments goes with its line end, in another the rest stays as it is; a document that loses all lines has an empty
text; rows that repeat lose the same; a null identifier counts as larger than any; an empty table gives none. Other
columns of the rows may have any name. The noncharacter ``MARK`` is dropped from texts that lose something, and a control character
``OPEN`` of a text counts as nothing or, at the ends of segments, as a blank.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import cut, let, shared_dir

LEADING, MIN_DOCS, CONSTANT, AGREE, LONG = 3, 3, 0.6, 0.8, 6
FIELD = "<*>"
#: Tiles a text: up to a sentence end with its blanks, or to the end of a line. Runs are greedy, as possessive ones are slower
#: in Java; what follows them always matches, so nothing is tried again.
PIECE = r"(?s)(?=.)[^\n.!?]*(?:[.!?]+(?![ \t\r.!?])[^\n.!?]*)*+(?:[.!?]+[ \t\r]+\n?|\n|\z)"
#: A token with a digit, without punctuation at its end, so that a sentence end stays one.
VARIABLE = r"(?<![^ \n\x02])[^ \n\x020-9]*[0-9](?:[^ \n.!?]++|[.!?]++(?=[^ \n.!?]))*+"
IS_FIELD = r"^<\*>[.!?]*$"
#: Size of the bitmaps that keep rows out of a shuffle (2 MB); beyond so many leaves it only keeps out fewer.
BITS = 1 << 24
#: A document's vote, which many numbers divide.
VOTE = 720_720
#: Begin of a line, while segments are found.
OPEN = "\x02"
#: Stands for a lost segment until its line is known to stay.
MARK = "\uffff"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def segments(docs: DataFrame, constant: float = CONSTANT) -> DataFrame:
    """``id``, ``digest`` of the text, ``no`` (from 0), ``masked``, ``n`` (tokens), ``leaf`` and ``line`` (hashes) of each segment that takes part."""

    text, masked = F.col("text").cast("string"), F.col("masked")
    # OPEN at the begin of each line and a line end after the last one, so that a piece tells whether it is a whole line.
    # Blanks and fields are seen to in the whole text, which moves no cut.
    marked = F.concat(F.lit(OPEN), F.replace(text, F.lit("\n"), F.lit(f"\n{OPEN}")), F.lit("\n"))
    gaps = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("  "))
    marked = F.when(gaps, F.regexp_replace(marked, "[ \t\r]{2,}+|[\t\r]", " ")).otherwise(marked)
    marked = F.when(F.regexp_like(text, F.lit(r"\A[^0-9]*\z")), marked).otherwise(F.regexp_replace(marked, VARIABLE, FIELD))
    # what stands beside an explode is made anew for each of its rows, so the digest comes out of one before
    one = F.array(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("digest"), pieces(marked).alias("pieces")))
    rows = docs.select(F.inline_outer(one)).select("id", "digest", F.posexplode_outer("pieces").alias("no", "piece"))
    whole = F.startswith("piece", F.lit(OPEN)) & F.endswith("piece", F.lit("\n"))
    bare = F.trim(F.replace(F.replace("piece", F.lit("\n"), F.lit("")), F.lit(OPEN), F.lit("")))
    rows = rows.select("id", "digest", "no", whole.alias("whole"), bare.alias("masked"))
    fields = F.when(F.contains(masked, F.lit(FIELD)), F.regexp_count(masked, F.lit(r"(?<![^ ])<\*>[.!?]*+(?![^ ])"))).otherwise(0)
    rows = rows.withColumns({"n": F.octet_length(masked) - F.octet_length(F.replace(masked, F.lit(" "), F.lit(""))) + 1, "fields": fields})
    keep = (F.col("whole") | (F.col("n") >= LONG)) & (F.col("n") - F.col("fields") >= F.lit(constant) * F.col("n")) & (masked != "")
    # A filter on these columns would be pushed below them and make them all again, and so would the test of its array
    # that an inner explode adds. What an outer one gives can't be pushed.
    rows = rows.select("*", F.explode_outer(F.when(keep, F.array(F.lit(1)))).alias("keep")).where(F.col("keep").isNotNull())
    return rows.select(
        "id", "digest", "no", "masked", "n", F.xxhash64("n", F.substring_index("masked", " ", LEADING)).alias("leaf"), F.xxhash64("masked").alias("line")
    )


def bitmap(hashes: DataFrame, key: str) -> DataFrame:
    """One row ``bits``: ``BITS`` bits as longs, of which those of the given hashes ``key`` are set. It has one size for any number of them."""
    bit = F.pmod(F.col(key), F.lit(BITS))
    words = hashes.select(F.floor(bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({key}, {BITS}L) % 64 as int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = hashes.sparkSession.range(BITS // 64).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    return every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("w")).select(F.col("w.bits").alias("bits"))


def sifted(rows: DataFrame, bits: DataFrame, key: str) -> DataFrame:
    """``rows`` whose hash ``key`` may be one of those in the bitmap; all that are one are among them.

    What follows should be an inner join: a semi join would be pushed below the test.
    """
    word = F.get("bits", F.expr(f"cast(floor(pmod({key}, {BITS}L) / 64) as int)"))
    test = word.bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod({key}, {BITS}L) % 64 as int))")) != 0
    return rows.crossJoin(F.broadcast(bits)).where(test).drop("bits")


def needed(n: Column, min_docs: int) -> Column:
    return F.when(n >= LONG, 2).otherwise(min_docs)


def known_id() -> Column:
    return F.coalesce("id", F.lit(2**63 - 1)).alias("id")


def holder() -> Column:
    """The text that keeps a template: that of the smallest identifier."""
    return F.min(F.struct(known_id(), "digest"))


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder, of which a later step reads only the columns that it needs."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> tuple[DataFrame, DataFrame]:
    """Places of all segments (``digest``, ``no``, ``leaf``, ``line`` and others), and the segments whose template recurs.

    The latter are ``leaf``, ``line`` and ``kept``, the digest of the text that keeps the template.
    """
    places = written(segments(docs, constant), "segments")

    def held(rows: DataFrame) -> DataFrame:
        return rows.groupBy("leaf", "line", "digest").agg(F.min("id").alias("id"), F.any_value("n").alias("n"))

    # Sums and smallest values of numbers are made by hash; a smallest struct would have all rows sorted.
    kinds = held(places).groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min(known_id()).alias("id"), F.min("digest").alias("low"), F.any_value("n").alias("n"))
    kinds = written(kinds, "kinds")
    leaves = kinds.groupBy("leaf").agg(F.count("*").alias("lines"), F.min("low").alias("low"), F.max("low").alias("high"), F.max("docs").alias("most"))
    mixed = cut(leaves.where("lines > 1 and (low <> high or most > 1)").select("leaf"))

    # leaves with one kind: the text of the smallest identifier, and of texts that share it the one of the smallest hash
    alone = cut(kinds.where(F.col("docs") >= needed(F.col("n"), min_docs)).join(mixed, "leaf", "left_anti").select("leaf", "line", "id"))
    alone = sifted(places.select("leaf", "line", known_id(), "digest"), bitmap(alone, "line"), "line").join(alone, ["leaf", "line", "id"])
    alone = alone.groupBy("leaf", "line").agg(F.min("digest").alias("kept"))

    # leaves with several kinds of segments: votes by place, of which each place of a leaf has as many
    bits = cut(bitmap(mixed, "leaf"))
    inside = cut(held(sifted(places, bits, "leaf").join(mixed, "leaf")))
    shares = inside.join(inside.groupBy("leaf", "digest").agg(F.count("*").alias("own")), ["leaf", "digest"])
    votes = cut(shares.groupBy("leaf", "line").agg(F.sum(F.floor(F.lit(VOTE) / F.col("own")).cast("long")).alias("votes")))
    votes = votes.join(votes.groupBy("leaf").agg(F.sum("votes").alias("all")), "leaf")
    told = sifted(places.select("leaf", "line", "n", "masked"), bits, "leaf").join(votes, ["leaf", "line"])
    told = cut(told.groupBy("leaf", "line").agg(F.any_value("masked").alias("masked"), *[F.any_value(c).alias(c) for c in ("n", "votes", "all")]))
    each = told.select("leaf", "votes", "all", F.posexplode_outer(F.split("masked", " ")).alias("at", "word"))
    values = each.groupBy("leaf", "at", "word").agg(F.sum("votes").alias("votes"), F.any_value("all").alias("all"))
    half = values.where((2 * F.col("votes") >= F.col("all")) & ~F.regexp_like("word", F.lit(IS_FIELD)))
    half = half.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("half"))
    # of words that share a place by halves the last one
    fixed = half.select("leaf", F.filter("half", lambda x, i: ~F.get("half", i + 1)["at"].eqNullSafe(x["at"])).alias("fixed"))
    own = told.join(fixed, "leaf", "left").select("leaf", "line", "n", "masked", F.coalesce("fixed", F.array().cast(dict(fixed.dtypes)["fixed"])).alias("fixed"))
    agrees = let(F.split("masked", " "), lambda words: F.size(F.filter("fixed", lambda x: F.get(words, x["at"]) == x["word"])))
    general = (F.size("fixed") >= F.lit(constant) * F.col("n")) & (agrees >= F.lit(AGREE) * F.size("fixed"))
    template = cut(own.select("leaf", "line", "n", F.when(general, F.lit(None).cast("long")).otherwise(F.col("line")).alias("template")))
    known = inside.select("leaf", "line", "digest", "id").join(template, ["leaf", "line"])
    often = (
        known.groupBy("leaf", "template", "digest").agg(F.min("id").alias("id"), F.any_value("n").alias("n"))
        .groupBy("leaf", "template").agg(F.count("*").alias("docs"), holder().alias("first"), F.any_value("n").alias("n"))
        .where(F.col("docs") >= needed(F.col("n"), min_docs))
    )
    often = often.select(F.col("leaf").alias("_leaf"), F.col("template").alias("_template"), F.col("first.digest").alias("kept"))
    several = template.join(often, (F.col("leaf") == F.col("_leaf")) & F.col("template").eqNullSafe(F.col("_template"))).select("leaf", "line", "kept")
    return places, alone.unionByName(several)


def cleaned(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """The other columns of each row of ``docs`` as ``row``, with ``text`` after segments are dropped, ``n_segments`` and ``n_dropped``."""
    places, found = recurring(docs, min_docs, constant)
    found = cut(found)
    lost = sifted(places.select("leaf", "line", "digest", "no"), bitmap(found, "line"), "line").join(found, ["leaf", "line"]).where("digest <> kept")
    lost = cut(lost.groupBy(F.col("digest").alias("_digest")).agg(F.sort_array(F.collect_set("no")).alias("_lost")))
    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64(text).alias("_digest"), text.alias("_text"), F.struct(*[F.col(f"`{n}`") for n in docs.columns if n != "text"]).alias("row"))
    rows = rows.join(lost, "_digest", "left")

    def rest(parts: Column) -> Column:
        """Runs of pieces between lost ones, each followed by what stands for the lost one."""
        lost = F.col("_lost")

        def run(at: Column, i: Column) -> Column:
            begin = F.coalesce(F.get(lost, i - 1), F.lit(-1)) + 1
            return F.concat(F.array_join(F.slice(parts, begin + 1, at - begin), ""), F.lit(MARK), F.when(F.endswith(F.get(parts, at), F.lit("\n")), "\n").otherwise(""))

        last = F.element_at(lost, -1)
        return F.concat(F.array_join(F.transform(lost, run), ""), F.array_join(F.slice(parts, last + 2, F.size(parts)), ""))

    def left(parts: Column) -> Column:
        gone = F.regexp_replace(rest(parts), rf"(?md)^[ \t\r]*+{MARK}[ \t\r{MARK}]*+(?:\n|\z)", "")
        gone = F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(F.replace(gone, F.lit(MARK), F.lit("")))
        return F.struct(gone.alias("text"), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_segments"))

    # The pieces are bound once, and what is made of them comes out of an explode: a filter on it would else make all anew.
    return rows.select("row", "_lost", F.inline_outer(F.array(let(pieces(F.col("_text")), left)))).select(
        "row", "text", "n_segments", F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped")
    )


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """``doc_id``, ``n_segments``, ``n_dropped`` and the ``text`` that is left of each row."""
    return cleaned(docs.select("doc_id", "text"), min_docs, constant).select("row.doc_id", "n_segments", "n_dropped", "text")


def keep_rest(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """``docs`` with the recurring segments dropped from the text, and without the documents that lose all they have.

    ``n_chars`` is set to the length of what is left where segments were dropped.
    """
    rest = cleaned(docs, min_docs, constant)
    rest = rest.where((F.col("n_dropped") == 0) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))

    def value(name: str) -> Column:
        if name == "text":
            return F.col("text")
        own = F.col(f"row.`{name}`")
        return F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(own).cast(dict(docs.dtypes)[name]) if name == "n_chars" else own

    return rest.select(*[value(n).alias(n) for n in docs.columns])


#: The definition in DuckDB: texts, lists of tokens and places themselves, no hashes.
SQL = f"""
with t as (select distinct text, min(doc_id) over (partition by text) as id from documents where text is not null),
by_line as (select id, text, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line_no, len(string_split(text, chr(10))) as n_lines from t),
cut as (
  select id, text, line_no, n_lines, list_filter(string_split(regexp_replace(raw, '([.!?]+[ \t\r]+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as segs from by_line),
s as (select id, text, line_no, n_lines, unnest(segs) as seg, generate_subscripts(segs, 1) as seg_no, len(segs) = 1 as whole from cut),
w as (
  select *, list_transform(list_filter(string_split_regex(seg, '[ \t\r]+'), lambda x: x <> ''), lambda x: case when regexp_matches(x, '[0-9]') then '{FIELD}' || regexp_extract(x, '[.!?]*$') else x end) as words from s),
p as (
  select *, (len(words), words[1:{LEADING}])::varchar as leaf from w
  where len(words) > 0 and (whole or len(words) >= {LONG}) and len(list_filter(words, lambda x: not regexp_matches(x, '{IS_FIELD}'))) >= {CONSTANT} * len(words)),
held as (select distinct leaf, words, id, text from p),
votes as (
  select leaf, words, sum({VOTE} // own) as votes from held join (select leaf, text, count(*) as own from held group by all) using (leaf, text) group by all),
each as (select leaf, words, votes, unnest(words) as word, generate_subscripts(words, 1) as place from votes),
tops as (
  select leaf, place, word, v, sum(v) over (partition by leaf, place) as whole from (select leaf, place, word, sum(votes) as v from each group by all)),
fixed as (
  select leaf, place, word as constant from tops where not regexp_matches(word, '{IS_FIELD}') and 2 * v >= whole
  qualify row_number() over (partition by leaf, place order by v desc, word desc) = 1),
agree as (
  select leaf, words, count(constant) as fixed, count(*) filter (where word = constant) as agrees from each left join fixed using (leaf, place) group by leaf, words),
template as (
  select leaf, words, case when fixed >= {CONSTANT} * len(words) and agrees >= {AGREE} * fixed then 'the template of the leaf' else words::varchar end as template from agree),
often as (
  select leaf, template, arg_min(text, id) as kept from (select distinct leaf, template, id, text, len(words) as n from held join template using (leaf, words))
  group by leaf, template having count(*) >= case when max(n) >= {LONG} then 2 else {MIN_DOCS} end),
lost as (
  select p.text, line_no, seg_no from p join template using (leaf, words) join often using (leaf, template) where p.text <> kept),
marked as (select s.*, l.seg_no is not null as gone from s left join lost l on s.text = l.text and s.line_no = l.line_no and s.seg_no = l.seg_no),
lines as (
  select text, line_no, n_lines, count(*) filter (where gone) as dropped, bool_and(gone or regexp_matches(seg, '^[ \t\r]*$')) as blank,
    string_agg(case when gone then '' else seg end, '' order by seg_no) as rest from marked group by all),
all_lines as (select c.text, c.line_no, c.n_lines, len(segs) as n_segs, coalesce(dropped, 0) as dropped, coalesce(blank, true) as blank, coalesce(rest, '') as rest
  from cut c left join lines l on c.text = l.text and c.line_no = l.line_no),
done as (
  select text, sum(dropped) as dropped,
    coalesce(string_agg(rest || case when line_no < n_lines then chr(10) else '' end, '' order by line_no) filter (where not (dropped > 0 and blank)), '') as rest
  from all_lines group by text),
pieces as (select text, sum(case when n_segs = 0 then case when line_no < n_lines then 1 else 0 end else n_segs end) as n from all_lines group by text)
select doc_id, cast(coalesce(n, 0) as bigint) as n_segments, cast(coalesce(dropped, 0) as bigint) as n_dropped, case when coalesce(dropped, 0) = 0 then d.text else rest end as text
from documents d left join done on d.text = done.text left join pieces on d.text = pieces.text
"""
