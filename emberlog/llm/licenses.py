"""Licence notices in documents, by a positional index of their rare words.

Every word of the known notices gets its inverse document frequency over all documents. The index has the ``ANCHORS``
rarest words of each notice with their place in it. A document's words are looked up in it, and each hit tells where
the notice would begin; where at least two anchors of a notice agree on that, the notice is laid over the document's
words. It counts if the words that fit have ``FITS`` of the notice's weight and all of its mandatory phrases are there.

Beside the index, three phrases are base places wherever their words stand one after the other.

Words are runs of ASCII letters and digits and of all that is not ASCII; A to Z count as a to z. ``lower()`` is used for
that: what else it changes is not ASCII before, and neither splits a word nor makes one of the phrases.

All is DataFrame functions. Texts stay where they are read; what is shuffled is hits of rare words. The number of
notices is fixed, so what is kept of them is a literal.

Defined cases: a null text counts as empty; without any word the counts are 0 and the labels empty; rows that repeat
give equal rows; an empty table gives none. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import cut, if_small

ANCHORS, FITS = 3, 0.8
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, notice, mandatory phrases.
NOTICES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl", "licensed under the GNU Affero General Public License", ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("cc0-1.0", "Released under CC0 1.0 Universal", ("cc0 1 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def told(notice: str) -> list[str]:
    return re.findall("[0-9a-z]+", notice.lower())


def texts(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def worded(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``clean`` (the words with a blank around each) and ``words``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clean = F.trim(F.regexp_replace(F.lower(text), GAP, " "))
    return (
        docs.select("doc_id", F.xxhash64(text).alias("digest"), clean.alias("clean"))
        .withColumn("words", F.when(F.col("clean") == "", F.array().cast("array<string>")).otherwise(F.split("clean", " ")))
        .withColumn("clean", F.concat(F.lit(" "), F.col("clean"), F.lit(" ")))
    )


def weights(rows: DataFrame) -> dict[str, tuple[int, float]]:
    """Documents and inverse document frequency of each word of the notices, over all of ``rows``."""
    vocabulary = sorted({w for _, notice, _ in NOTICES for w in told(notice)})
    own = F.concat(F.array_intersect("words", texts(vocabulary)), F.array(F.lit("")))  # the empty word counts all documents
    counts = {r["word"]: r["n"] for r in rows.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    every = counts.get("", 0)
    inverse = F.log((F.lit(every) + 1) / (F.col("n") + 1)) + 1
    spark = rows.sparkSession
    table = spark.createDataFrame([(w, counts.get(w, 0)) for w in vocabulary], "word string, n long").select("word", "n", inverse.alias("idf"))
    return {r["word"]: (r["n"], r["idf"]) for r in table.collect()}


def base_places(phrase: str) -> Column:
    """Where the words of ``phrase`` stand, counted in words from 0."""
    parts = phrase.split()

    def fits(i: Column) -> Column:
        out = F.get("words", i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            out = out & (F.get("words", i + j) == part)
        return out

    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), fits)
    return F.when(F.contains("clean", F.lit(f" {phrase} ")), places).otherwise(F.array().cast("array<int>"))


def laid(rows: DataFrame, weight: dict[str, tuple[int, float]]) -> DataFrame:
    """``doc_id``, ``digest``, ``label``, ``score`` for each notice that stands somewhere in a document."""
    index: dict[str, list[tuple[int, int]]] = {}
    anchors: list[int] = []
    for number, (_, notice, _) in enumerate(NOTICES):
        words = told(notice)
        rare = sorted(set(words), key=lambda w: (weight[w][0], w))[:ANCHORS]
        anchors.append(len(rare))
        for place, word in enumerate(words):
            if word in rare:
                index.setdefault(word, []).append((number, place))
    postings = F.create_map(*[x for word, at in sorted(index.items()) for x in (F.lit(word), F.array(*[F.struct(F.lit(n).alias("notice"), F.lit(p).alias("place")) for n, p in at]))])
    looked_up = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(sorted(index)))
    begins = F.flatten(F.transform(looked_up, lambda x: F.transform(F.element_at(postings, x["word"]), lambda e: F.struct(e["notice"].alias("notice"), e["place"].alias("place"), (x["at"] - e["place"]).alias("begin")))))
    notices = F.array(*[texts(told(notice)) for _, notice, _ in NOTICES])
    weighed = F.array(*[F.array(*[F.lit(weight[w][1]) for w in told(notice)]) for _, notice, _ in NOTICES])
    phrases = F.array(*[texts([f" {p} " for p in must]) for *_, must in NOTICES])
    enough = F.get(texts([label for label, *_ in NOTICES]), F.col("notice"))
    wanted = F.get(notices, F.col("notice"))
    hits = rows.where(F.arrays_overlap("words", texts(sorted(index)))).select("doc_id", "digest", "words", F.explode(begins).alias("b")).select("doc_id", "digest", "b.*", "words")
    over = hits.select("doc_id", "digest", "notice", "place", "begin", F.transform(F.sequence(F.lit(0), F.size(wanted) - 1), lambda j: F.get("words", F.col("begin") + j)).alias("found"))
    agreed = (
        over.groupBy("doc_id", "digest", "notice", "begin")
        .agg(F.size(F.collect_set("place")).alias("anchors"), F.any_value("found").alias("found"))
        .where(F.col("anchors") >= F.least(F.lit(2), F.get(F.array(*[F.lit(a) for a in anchors]), F.col("notice"))))
    )
    each = F.get(weighed, F.col("notice"))
    fitting = F.aggregate(F.sequence(F.lit(0), F.size("found") - 1), F.lit(0.0), lambda sum_, j: sum_ + F.when(F.get("found", j) == F.get(wanted, j), F.get(each, j)).otherwise(F.lit(0.0)))
    full = F.aggregate(each, F.lit(0.0), lambda sum_, w: sum_ + w)
    spoken = F.concat(F.lit(" "), F.array_join("found", " ", "?"), F.lit(" "))
    return (
        agreed.withColumn("score", F.round(fitting / full, 6))
        .where((F.col("score") >= FITS) & F.forall(F.get(phrases, F.col("notice")), lambda p: F.contains(spoken, p)))
        .select("doc_id", "digest", enough.alias("label"), "score")
    )


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, base places (``n_base``, ``first_word``, ``last_word``), ``base_labels``, ``labels`` and ``score``.

    The score is the best of the notices', and 1 for a document with a base phrase.
    """
    rows = worded(docs)
    method = laid(rows, weights(rows)).groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"), F.col("digest").alias("_digest")).agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    places = [base_places(p).alias(f"b{i}") for i, p in enumerate(BASE)]
    based = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"), F.col("digest").alias("_digest"), "doc_id", F.size("words").cast("long").alias("n_words"), *places)
    every = F.concat(*[F.col(f"b{i}") for i in range(len(BASE))])
    own = F.array_compact(F.array(*[F.when(F.size(f"b{i}") > 0, F.lit(label)) for i, label in enumerate(BASE.values())]))
    none = F.array().cast("array<string>")
    return based.join(if_small(cut(method)), ["_key", "_digest"], "left").select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.sort_array(own), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(own, F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"),
    )


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: The same in DuckDB.
SQL = f"""
with w as (
  select doc_id, text, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as words from documents),
notices as (
  select * from (values {", ".join(f"({i}, '{label}', {_list(told(notice))}, {_list([f' {p} ' for p in must])})" for i, (label, notice, must) in enumerate(NOTICES))})
  as v(notice, label, wanted, phrases)),
vocabulary as (select distinct unnest(wanted) as word from notices),
df as (
  select word, count(doc_id) as n from vocabulary left join (select doc_id, unnest(list_distinct(words)) as word from w) using (word) group by word),
idf as (select word, n, ln(((select count(*) from w) + 1) / (n + 1)) + 1 as idf from df),
spread as (select notice, label, unnest(wanted) as word, generate_subscripts(wanted, 1) - 1 as place from notices),
ranked as (
  select notice, word, row_number() over (partition by notice order by n, word) as rank
  from (select distinct notice, word from spread) join idf using (word)),
anchors as (select spread.* from spread join ranked using (notice, word) where rank <= {ANCHORS}),
doc_words as (select doc_id, text, unnest(words) as word, generate_subscripts(words, 1) - 1 as pos from w),
agreed as (
  select doc_id, text, notice, label, pos - place as origin from doc_words join anchors using (word)
  group by all having count(distinct place) >= 2),
laid as (
  select a.doc_id, a.text, a.notice, a.label, a.origin, sum(case when w.words[a.origin + s.place + 1] = s.word and a.origin + s.place >= 0 then idf else 0 end) / sum(idf) as score
  from agreed a join spread s using (notice) join idf using (word) join w on w.doc_id = a.doc_id group by all),
fits as (
  select l.doc_id, l.label, round(l.score, 6) as score from laid l join notices n using (notice) join w on w.doc_id = l.doc_id
  where round(l.score, 6) >= {FITS} and len(list_filter(n.phrases, lambda p: contains(' ' || array_to_string(
    list_transform(range(len(n.wanted)), lambda j: case when l.origin + j >= 0 then coalesce(w.words[l.origin + j + 1], '?') else '?' end), ' ') || ' ', p))) = len(n.phrases)),
method as (select doc_id, list(distinct label) as more, max(score) as best from fits group by doc_id),
b as (
  select doc_id, len(words) as n_words, {", ".join(
    f"list_filter(range(len(words)), lambda i: {' and '.join(f'''words[i + {j + 1}] = '{p}' ''' for j, p in enumerate(phrase.split()))}) as b{i}" for i, phrase in enumerate(BASE))}
  from w),
o as (
  select doc_id, n_words, {" || ".join(f"b{i}" for i in range(len(BASE)))} as every,
    list_filter([{", ".join(f"case when len(b{i}) > 0 then '{label}' end" for i, label in enumerate(BASE.values()))}], lambda x: x is not null) as own from b)
select doc_id, cast(n_words as bigint) as n_words, cast(len(every) as bigint) as n_base, cast(list_min(every) as bigint) as first_word,
  cast(list_max(every) as bigint) as last_word, array_to_string(list_sort(own), ',') as base_labels,
  array_to_string(list_sort(list_distinct(own || coalesce(more, []))), ',') as labels,
  cast(greatest(coalesce(best, 0), case when len(every) > 0 then 1 else 0 end) as double) as score
from o left join method using (doc_id)
"""
