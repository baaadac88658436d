"""Mixing sources to target weights by entropy balancing.

A document's rate is the number of times that the mix takes it. Among all rates up to ``cap`` that give each source
its target of words, entropy balancing wants those nearest to 1 (Kullback and Leibler). The convex dual has one
multiplier per source, and its solution tilts exponentially: ``rate = min(cap, exp(multiplier * size / scale))``.
Each Newton step is one aggregation over the documents, which are first counted by source and size, so a source with
a third of all rows costs a few thousand rows. A step that leaves the bracket of a source halves the bracket instead.

Rates become whole copies by carrying the rounding error on, from large documents to small ones, inside chunks of
about ``CHUNK`` documents of a source; what is left over is made up by a few single copies. So a source misses its
target by a few words for each chunk.

Rows with the same identifier and text are counted before they are dealt to chunks, ``CHUNK`` of them at a time, so
copies of one row fill as many chunks as they need.

Defined cases: a null text has size 0 and no copies; null is a source of its own, sorted last; rows that repeat are
rows of their own; an empty table gives none. A column ``mix_copies`` that is there already is renamed. Sums that decide a copy are decimal, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import cut, if_small

#: Weights of the sources in code point order, over and over.
WEIGHTS = (1, 2, 3)
#: A document is taken at most so many times, and a source's target is at most so many times its size.
CAP = 3
CHUNK = 1000
#: Changes by one copy that may bring a chunk nearer to its words.
REPAIRS = 8
#: A source's words may miss its target by this share before rounding.
TOLERANCE = 1e-7
#: And by so many words, which is above what rounding takes from sums: a small source's share of a word is never met.
WORDS_OFF = 0.01
STEPS = 60
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``source``, ``name`` (never null) and ``size`` in words of each row."""
    return docs.select(
        F.col("doc_id"),
        F.xxhash64("text").alias("digest"),
        F.col("source").alias("source"),
        F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("name"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``sources`` (``name``, ``source``, ``source_size``) with ``target``.

    Shares by weight fill up like water: with sources in the order of ``limit / weight``, the level is what is left
    over all weights left, at its highest. A source gets level times weight, or its limit if that is less. The
    windows run over a row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    limits = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return limits.withColumn("level", level).withColumn("target", F.least("limit", F.col("weight") * F.max("level").over(whole)))


def multipliers(counts: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """``sources`` (``name``, ``source_size``, ``target``, ``scale``) with ``tilt``, the multiplier of the dual.

    ``counts`` has the number ``n`` of documents for each ``name`` and ``size`` above 0. A source at its limit has no
    finite multiplier and gets null.
    """
    start = F.log(F.try_divide(F.col("target"), F.col("source_size").cast("double")))
    state = cut(
        sources.where((F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * F.lit(float(cap)) * (1 - 1e-12)))
        .select("name", "target", "scale", start.alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(None).cast("double").alias("missed"))
    )

    def exact(x: object) -> object:
        return F.sum(F.round(x, 6).cast("decimal(38,6)")).cast("double")

    for _ in range(STEPS):
        x = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * x, F.lit(50.0))))
        mass = F.col("n") * F.col("size") * rate
        sums = (
            counts.join(if_small(state), "name")
            .groupBy("name")
            .agg(exact(mass).alias("got"), exact(F.when(rate < float(cap), mass * x).otherwise(F.lit(0.0))).alias("slope"))
        )
        excess = F.col("got") - F.col("target")
        stepped = (
            state.join(if_small(cut(sums)), "name")
            .withColumn("missed", F.abs(excess) / F.greatest(F.col("target"), F.lit(WORDS_OFF / TOLERANCE)))
            .withColumn("low", F.when(excess < 0, F.col("tilt")).otherwise(F.col("low")))
            .withColumn("high", F.when(excess > 0, F.col("tilt")).otherwise(F.col("high")))
            .withColumn("newton", F.col("tilt") - F.try_divide(excess, F.col("slope")))
            .withColumn(
                "tilt",
                F.when(F.col("missed") <= TOLERANCE, F.col("tilt"))
                .when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton"))
                .otherwise((F.greatest("low", F.lit(-64.0)) + F.least("high", F.lit(64.0))) / 2),
            )
        )
        state = cut(stepped.select("name", "target", "scale", "tilt", "low", "high", "missed"))
        if not state.where(F.col("missed") > TOLERANCE).limit(1).count():
            break
    return sources.join(state.select("name", "tilt"), "name", "left")


def copies(rows: pd.DataFrame, cap: int = CAP) -> np.ndarray:
    """Whole copies of the documents of a chunk, whose words come as near to the sum of the rates' as they can."""
    out = np.zeros(len(rows), np.int64)
    order = np.lexsort((rows["digest"], rows["doc_id"].fillna(-1), -rows["size"]))
    size, rate, owed = rows["size"].to_numpy(), rows["rate"].to_numpy(), 0.0
    for i in order:
        if s := int(size[i]):
            owed += s * rate[i]
            out[i] = min(cap, max(0, round(owed / s)))
            owed -= int(out[i]) * s
    for _ in range(REPAIRS):  # one copy more here, one less there, or only one of both
        more = np.r_[0, np.unique(size[(out < cap) & (size > 0)])]
        less = np.r_[0, np.unique(size[(out > 0) & (size > 0)])]
        near = np.searchsorted(more, owed + less)
        pairs = [(abs(owed - int(more[k]) + int(d)), int(more[k]), int(d)) for d, n in zip(less, near, strict=True) for k in (n - 1, n) if 0 <= k < len(more)]
        miss, up, down = min(pairs)
        if miss > abs(owed) - 0.5:
            break
        if up:
            out[next(i for i in order if size[i] == up and out[i] < cap)] += 1
        if down:
            out[next(i for i in order if size[i] == down and out[i] > 0)] -= 1
        owed += down - up
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words), ``copies``, ``rate`` and ``digest`` of each row."""
    rows = cut(sizes(docs))
    counts = cut(rows.groupBy("name", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")))
    per_source = counts.groupBy("name").agg(
        F.first("source").alias("source"),
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.try_divide(F.sum((F.col("n") * F.col("size") * F.col("size")).cast("decimal(38,0)")).cast("double"), F.sum(F.col("n") * F.col("size"))).alias("scale"),
        F.sum("n").alias("documents"),
    )
    sources = cut(targets(cut(per_source), weights, cap))
    solved = cut(multipliers(counts.where("size > 0"), sources, cap))
    tilted = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0)))
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("tilt").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), tilted))
    blocks = rows.groupBy("doc_id", "digest", "name", "size").agg(F.count("*").alias("n"))
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK).cast("long"))))
    equal = F.least(F.lit(CHUNK).cast("long"), F.col("n") - F.col("block") * CHUNK)
    chunk = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("digest"), F.col("block")), F.ceil(F.col("documents") / CHUNK))
    rated = blocks.join(if_small(solved.select("name", "source_size", "target", "tilt", "scale", "documents")), "name").select(
        "doc_id", "digest", "name", chunk.alias("chunk"), "size", "source_size", "target", rate.alias("rate"), equal.alias("equal")
    )

    def rounded(part: pd.DataFrame) -> pd.DataFrame:
        part = part.loc[part.index.repeat(part["equal"])].reset_index(drop=True)
        part["copies"] = copies(part, cap)
        part["taken"] = part["copies"] * part["size"]
        return part[["doc_id", "size", "source_size", "target", "taken", "copies", "rate", "digest"]]

    schema = f"doc_id {dict(rated.dtypes)['doc_id']}, size long, source_size long, target double, taken long, copies long, rate double, digest long"
    return rated.groupBy("name", "chunk").applyInPandas(rounded, schema)


def apply(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with a last column ``mix_copies``, the documents that the mix doesn't take left out.

    Rows with the same identifier and text become one row, whose copies add up.
    """
    while (old := next((n for n in docs.columns if n.lower() == "mix_copies"), None)) is not None:
        new = f"{old}_before"
        while new.lower() in map(str.lower, docs.columns):
            new += "_before"
        docs = docs.withColumnRenamed(old, new)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    taken = mix(docs, weights, cap).where("copies > 0").groupBy(key.alias("_key"), F.col("digest").alias("_digest")).agg(F.sum("copies").alias("_copies"))
    held = docs.select(key.alias("_key"), F.xxhash64("text").alias("_digest"), F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_row"))
    one = Window.partitionBy("_key", "_digest").orderBy(F.lit(0))
    return (
        held.join(taken, ["_key", "_digest"])
        .withColumn("_no", F.row_number().over(one))
        .where("_no = 1")
        .select("_row.*", F.col("_copies").alias("mix_copies"))
    )
