"""Personal data in whole texts: generators propose spans, boosted trees score them, calibrated thresholds choose.

Addresses of mail, internet addresses, card numbers and telephone numbers of the usual form are base spans, found by
pattern and check; they always stay. Generators of high recall propose more, which may overlap: spelled-out mail
addresses, defanged internet addresses, digits with other separators, telephone numbers without a country.

Nobody has labelled such spans, so the base teaches. What a generator proposes inside of a base span is an example of
personal data, what it proposes outside and what fails the base's checks is one of other text. Features are the form
(digits, groups, separators, checksum) and the context (neighbours, words before). Equal feature vectors are counted
first, over all documents, so the trees are grown on a table that has a row for each vector: a split is a histogram of
gradients by feature and value and a running sum over it, and only the chosen split comes to the driver.

A fifth of the texts, by their checksum, is kept back. There the scores of each generator are gone through from the top,
and its threshold is the lowest score down to which ``PRECISION`` of the proposals lie in base spans. A generator
without such a score adds nothing.

All is DataFrame functions. A text never leaves its row, and is searched as a whole in time that grows with its length.

Defined cases: a null text counts as empty and has no spans; a row is answered for each row, also for rows that
repeat; an empty table gives none; without any base span nothing is added. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import cut, let, running

#: Kinds in the order of spans that begin together. The first four are the base, the others their looser forms.
KINDS = ("email", "ip", "card", "phone", "email_like", "ip_like", "card_like", "phone_like")
BASE = 4

# Patterns give what plain greedy ones give. Possessive parts and the look behind keep them linear: a match that begins
# inside of a run of characters would have begun with the run, or where the last match ended.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = (
    rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
AT, DOT = r"\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?", r"(?:\.|\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?)"
LOOSE = (
    rf"(?<![{LOCAL}])[{LOCAL}]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++",
    rf"(?<![0-9])[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}}(?![0-9])",
    r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}(?![0-9])",
    r"(?<![0-9+])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,4}(?![0-9])",
)
#: Characters that a hit of a base pattern has at least if it passes; shorter ones are no candidates.
SHORTEST = (1, 1, 14, 11)
#: What a text needs for any span, and for one of a kind, so that most texts are looked at once.
ANY = r"[0-9@]|[\[({]\x20?(?:at|AT)"
NEEDS = (r"@", r"[0-9]\.[0-9]", r"[0-9]", r"\+[0-9]")
LOOSE_NEEDS = (r"[\[({]\x20?(?:at|AT)", r"[0-9]", r"[0-9]", r"[0-9]")
#: Stands for each character of a base span in the text that the loose generators see.
BLANK = "\x01"

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
#: Words that stand before personal data, by what they announce.
CUES = (
    r"(?i)\b(?:tel|telefon|teléfono|téléphone|phone|call|mobile|mobil|fax|ring)\b",
    r"(?i)\b(?:mail|e-mail|email|correo|courriel|contact|write)\b",
    r"(?i)\b(?:card|visa|mastercard|amex|credit|account|konto|tarjeta|carte|iban)\b",
    r"(?i)\b(?:ip|host|server|addr|address|login|from|client)\b",
)
#: Characters before and after a span that count as its context.
BEFORE, AFTER = 40, 8

FEATURES = ("family", "digits", "groups", "longest", "separator", "check", "before", "after", "cue", "length")
#: Trees of two levels, their weight, and what is added to the curvature of a leaf.
ROUNDS, RATE, LAMBDA = 8, 0.7, 1.0
#: Share of a generator's proposals above its threshold that have to lie in base spans, and how many there have to be.
PRECISION, LEAST = 0.95, 20
#: One text in so many is kept for the thresholds.
FOLDS = 5

SPAN = "struct<begin:bigint,kind:int,end:bigint>"
CANDIDATE = "array<struct<begin:bigint,kind:int,end:bigint,source:int,valid:boolean,hit:string,before:string,after:string>>"
#: Where a candidate comes from: the base patterns, a loose pattern inside of a base span, or one outside.
OF_BASE, INSIDE, OUTSIDE = 0, 1, 2
NONE = f"cast(array() as {CANDIDATE})"


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check: each second digit from the right counts doubled, its digits added."""

    def digit(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1))
        return F.when(i % 2 == 1, F.translate(d, "0123456789", "0246813579")).otherwise(d).cast("int")

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda total, i: total + digit(i)) % 10 == 0


def passes(family: int, hit: Column) -> Column:
    """The base's check on a hit in its usual form."""
    if family == 0:
        return F.lit(True)
    if family == 1:
        return F.regexp_like(hit, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    if family == 2:
        return let(digits_of(hit), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    return F.length(digits_of(hit)).between(10, 15)


def parts(text: Column, pattern: str, needs: str) -> Column:
    """``gaps`` and ``hits``: what the matches of ``pattern`` leave between them, and the matches. Null for a null text."""
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    none = F.struct(F.array(text).alias("gaps"), F.expr("cast(array() as array<string>)").alias("hits"))
    return F.when(F.regexp_like(text, F.lit(needs)), found).when(text.isNotNull(), none)


def blanked(cut_text: Column, test: Callable[[Column, Column, Column], Column]) -> Column:
    """The text, with each hit that passes ``test`` (of the gap before, the hit and the gap after) replaced by as many ``BLANK``."""

    def shown(hit: Column, i: Column) -> Column:
        gap = F.get(cut_text["gaps"], i)
        return F.concat(gap, F.when(test(gap, hit, F.get(cut_text["gaps"], i + 1)), F.repeat(F.lit(BLANK), F.length(hit))).otherwise(hit))

    return F.concat(F.array_join(F.transform(cut_text["hits"], shown), ""), F.element_at(cut_text["gaps"], -1))


def once_blanked(text: Column, pattern: str, needs: str, test: Callable[[Column, Column, Column], Column]) -> Column:
    """``blanked`` of a text, in an expression that names it once: a filter that the optimizer pushes down grows no further."""
    return let(
        let(text, lambda t: parts(t, pattern, needs)),
        lambda found: F.when(F.size(found["hits"]) > 0, blanked(found, test)).otherwise(F.get(found["gaps"], F.lit(0))),
    )


def side(char: Column) -> Column:
    """0 blank or nothing, 1 letter or digit, 2 another character."""
    return F.when((char == "") | F.regexp_like(char, F.lit(r"^[\s\x01]$")), 0).when(F.regexp_like(char, F.lit(r"^[\p{L}\p{N}]$")), 1).otherwise(2)


def features(kind: Column, hit: Column, before: Column, after: Column) -> Column:
    """The values of ``FEATURES`` as whole numbers from 0 to 20. Loose forms are looked at in their usual spelling."""
    family = kind % BASE

    def up_to(value: Column, most: int) -> Column:
        return F.least(value, F.lit(most)).cast("int")

    def of(shape: Column) -> Column:
        runs = F.regexp_extract_all(shape, F.lit("[0-9]+"), F.lit(0))
        separator = (
            F.when(F.contains(shape, F.lit("(")), 4).when(F.contains(shape, F.lit("-")), 3).when(F.contains(shape, F.lit(" ")), 1)
            .when(F.contains(shape, F.lit(".")), 2).when(F.regexp_like(shape, F.lit("[_/]")), 5).otherwise(0)
        )
        checked = F.when(family == 0, F.regexp_like(shape, F.lit(r"\.[A-Za-z]{2,24}$")))
        for k in range(1, BASE):
            checked = checked.when(family == k, passes(k, shape))
        cue = F.lit(0)
        for number, words in reversed(list(enumerate(CUES, 1))):
            cue = F.when(F.regexp_like(before, F.lit(words)), number).otherwise(cue)
        longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
        return F.array(
            family, up_to(F.length(digits_of(shape)), 20), up_to(F.size(runs), 8), up_to(longest, 20), separator, checked.cast("int"),
            side(F.right(before, F.lit(1))), side(F.left(after, F.lit(1))), cue, up_to((F.length(shape) / 2).cast("int"), 20),
        )

    mail = F.regexp_replace(F.regexp_replace(hit, AT, "@"), DOT, ".")
    return let(F.when(kind == BASE, mail).when(kind == BASE + 1, F.regexp_replace(hit, DOT, ".")).otherwise(hit), of)


def placed(cut_text: Column, family: int, loose: bool, teach: bool) -> Column:
    """Candidates of one generator, with their places in code points."""
    gaps, hits = cut_text["gaps"], cut_text["hits"]
    steps = F.transform(hits, lambda hit, i: F.length(F.get(gaps, i)) + F.length(hit))

    def struct(begin: Column, kind: int, end: Column, source: int, valid: Column, hit: Column, before: Column, after: Column) -> Column:
        return F.struct(begin.alias("begin"), F.lit(kind).alias("kind"), end.alias("end"), F.lit(source).alias("source"), valid.alias("valid"), hit.alias("hit"), before.alias("before"), after.alias("after"))

    def one(hit: Column, i: Column, ends: Column) -> Column:
        around = F.right(F.get(gaps, i), F.lit(BEFORE)), F.left(F.get(gaps, i + 1), F.lit(AFTER))
        end, nowhere = F.get(ends, i), F.lit(-1).cast("long")
        if loose:
            return F.array(struct(end - F.length(hit), family + BASE, end, OUTSIDE, F.lit(False), hit, *around))
        whole = F.array(struct(end - F.length(hit), family, end, OF_BASE, passes(family, hit), hit, *around)).cast(CANDIDATE)
        if teach:  # and the loose form in it, without which there would be no examples
            inner = F.array(hit) if family == 0 else F.regexp_extract_all(hit, F.lit(LOOSE[family]), F.lit(0))
            inside = F.when(passes(family, hit), F.transform(inner, lambda form: struct(nowhere, family + BASE, nowhere, INSIDE, F.lit(True), form, *around)))
            whole = F.concat(whole, F.coalesce(inside.cast(CANDIDATE), F.expr(NONE)))
        return F.when(F.length(hit) >= SHORTEST[family], whole).otherwise(F.expr(NONE))

    return F.when(F.size(hits) > 0, let(running(steps), lambda ends: F.flatten(F.transform(hits, lambda hit, i: one(hit, i, ends)))).cast(CANDIDATE)).otherwise(F.expr(NONE))


def unbased(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rest``: ``text`` without its base spans, kind by kind. Card numbers come last, as they may be parts of others."""

    def checked(family: int) -> Callable[[Column, Column, Column], Column]:
        return lambda before, hit, after: passes(family, hit)

    rows = rows.withColumn("rest", F.col("text"))
    for family in (0, 1, 3, 2):
        rows = rows.withColumn("rest", once_blanked(F.col("rest"), PATTERNS[family], NEEDS[family], checked(family)))
    return rows


def proposed(rows: DataFrame, teach: bool = True) -> DataFrame:
    """``rows`` (``text`` and others) with ``found``, what the generators propose, as ``CANDIDATE``; without ``teach`` only what an answer needs."""
    rows = unbased(rows.withColumn("text", F.when(F.regexp_like("text", F.lit(ANY)), F.col("text"))))

    def of(text: Column, family: int, loose: bool) -> Column:
        pattern, needs = (LOOSE[family], LOOSE_NEEDS[family]) if loose else (PATTERNS[family], NEEDS[family])
        return let(parts(text, pattern, needs), lambda found: placed(found, family, loose, teach))

    base = let(F.col("text"), lambda text: F.concat(*[of(text, k, False) for k in range(BASE)]))
    loose = let(F.col("rest"), lambda rest: F.concat(*[of(rest, k, True) for k in range(BASE)]))
    return rows.withColumn("found", F.when(F.col("text").isNotNull(), F.concat(base, loose)).otherwise(F.expr(NONE))).drop("rest")


# --- trees ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """A split of two levels: ``feature <= at``, then a split on each side. Leaves from left to right."""

    feature: int
    at: int
    sides: tuple[tuple[int, int, float, float], ...]

    def value(self, values: Column) -> Column:
        low, high = (F.when(F.get(values, F.lit(f)) <= t, F.lit(left)).otherwise(F.lit(right)) for f, t, left, right in self.sides)
        return F.when(F.get(values, F.lit(self.feature)) <= self.at, low).otherwise(high)


@dataclass(frozen=True)
class Model:
    trees: tuple[Tree, ...]
    #: Lowest score that is chosen, for kinds that add anything.
    thresholds: dict[int, float]

    def score(self, values: Column) -> Column:
        total = F.lit(0.0)
        for tree in self.trees:
            total = total + tree.value(values)
        return F.round(total, 6)


def examples(docs: DataFrame) -> DataFrame:
    """Counted feature vectors: ``kind``, ``source``, ``features``, ``valid``, ``held`` (kept for the thresholds) and ``n``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = proposed(docs.select(text.alias("text"), (F.pmod(F.crc32(text), F.lit(FOLDS)) == 0).alias("held")))
    each = rows.select("held", F.explode("found").alias("c")).select("held", "c.*")
    each = each.withColumn("features", features(F.col("kind"), F.col("hit"), F.col("before"), F.col("after")))
    return each.groupBy("kind", "source", "features", "valid", "held").agg(F.count("*").alias("n"))


def best_splits(graded: DataFrame) -> list:
    """The best split of each ``node``: ``feature``, ``bin`` and the sums of gradients and curvatures on both sides."""
    bins = graded.select("node", "g", "h", F.posexplode("features").alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    below = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    sides = bins.select(
        "node", "feature", "bin",
        F.sum("g").over(below).alias("gl"), F.sum("h").over(below).alias("hl"),
        F.coalesce(F.sum("g").over(above), F.lit(0.0)).alias("gr"), F.coalesce(F.sum("h").over(above), F.lit(0.0)).alias("hr"),
    )
    gain = F.col("gl") ** 2 / (F.col("hl") + LAMBDA) + F.col("gr") ** 2 / (F.col("hr") + LAMBDA)
    order = F.struct(F.round(gain, 6), -F.col("feature"), -F.col("bin"))
    return sides.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "gl", "hl", "gr", "hr"), order).alias("s")).select("node", "s.*").collect()


def grown(counted: DataFrame, rounds: int = ROUNDS) -> tuple[Tree, ...]:
    """Newton boosting of the logistic loss on counted feature vectors (cut)."""
    trees: list[Tree] = []
    train = counted.where("not held")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-Model(tuple(trees), {}).score(F.col("features"))))
        graded = train.withColumn("p", p).select("features", (F.col("n") * (F.col("p") - F.col("valid").cast("int"))).alias("g"), (F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h"))
        if not (root := best_splits(graded.withColumn("node", F.lit(0)))):
            break
        feature, at = root[0]["feature"], root[0]["bin"]
        found = {r["node"]: r for r in best_splits(graded.withColumn("node", (F.get("features", F.lit(feature)) > at).cast("int")))}

        def leaves(side: int) -> tuple[int, int, float, float]:
            if (r := found.get(side)) is None:
                return 0, 0, 0.0, 0.0
            return r["feature"], r["bin"], *(round(-RATE * r[g] / (r[h] + LAMBDA), 9) for g, h in (("gl", "hl"), ("gr", "hr")))

        trees.append(Tree(feature, at, (leaves(0), leaves(1))))
    return tuple(trees)


def thresholds(counted: DataFrame, trees: tuple[Tree, ...], precision: float = PRECISION, least: int = LEAST) -> dict[int, float]:
    """For each loose kind the lowest score down to which enough of the held-back proposals lie in base spans."""
    rows = counted.where(F.col("held") & (F.col("source") != OF_BASE)).withColumn("score", Model(trees, {}).score(F.col("features")))
    each = rows.groupBy("kind", "score").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("valid").cast("int")).alias("right"))
    down = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = each.select("kind", "score", F.sum("all").over(down).alias("all"), F.sum("right").over(down).alias("right"))
    good = sums.where((F.col("right") >= precision * F.col("all")) & (F.col("right") >= least))
    return {r["kind"]: r["score"] for r in good.groupBy("kind").agg(F.min("score").alias("score")).collect()}


def trained(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    counted = cut(examples(docs))
    trees = grown(counted, rounds)
    return Model(trees, thresholds(counted, trees))


# --- answers --------------------------------------------------------------------------------


def told(spans: Column) -> Column:
    """``kind:start:end`` of spans in their order."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def chosen(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``base`` and ``added``: spans as ``begin``, ``kind`` and ``end``."""

    def spans(found: Column) -> Column:
        return F.transform(found, lambda c: F.struct(c["begin"], c["kind"], c["end"])).cast(f"array<{SPAN}>")

    def enough(c: Column) -> Column:
        limit = F.lit(float("inf"))
        for kind, score in model.thresholds.items():
            limit = F.when(c["kind"] == kind, F.lit(score)).otherwise(limit)
        return let(features(c["kind"], c["hit"], c["before"], c["after"]), model.score) >= limit

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = proposed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), teach=False)
    base = F.filter("found", lambda c: (c["source"] == OF_BASE) & c["valid"])
    loose = F.filter("found", lambda c: c["source"] == OUTSIDE)
    return rows.select("doc_id", spans(base).alias("base"), spans(F.filter(loose, enough)).alias("added"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each row of ``docs``: counts and digest of the base spans, all spans, and how many were added."""
    docs = docs.select("doc_id", "text")
    rows = chosen(docs, model or trained(docs))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return rows.select(
        "doc_id",
        *[count(kind) for kind in range(BASE)],
        F.sha2(told(F.col("base")), 256).alias("base_sha256"),
        told(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, model: Model | None = None, mark: str = "[redacted]") -> DataFrame:
    """``docs`` with ``mark`` in place of all spans, of base kinds and added ones; ``BLANK`` itself counts as one."""
    model = model or trained(docs.select("doc_id", "text"))

    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), F.when(F.regexp_like(text, F.lit(rf"{ANY}|{BLANK}")), text).alias("text"))
    rows = unbased(rows)

    def likely(kind: int) -> Callable[[Column, Column, Column], Column]:
        def test(gap: Column, hit: Column, next_gap: Column) -> Column:
            found = features(F.lit(kind), hit, F.right(gap, F.lit(BEFORE)), F.left(next_gap, F.lit(AFTER)))
            return let(found, model.score) >= F.lit(model.thresholds[kind])

        return test

    for kind in sorted(model.thresholds):
        rows = rows.withColumn("rest", once_blanked(F.col("rest"), LOOSE[kind - BASE], LOOSE_NEEDS[kind - BASE], likely(kind)))
    done = F.when(F.col("rest").isNull(), F.col("row.text").cast("string")).otherwise(F.regexp_replace("rest", f"{BLANK}+", mark))
    return rows.select(*[done.alias(n) if n == "text" else F.col(f"row.`{n}`") for n in docs.columns])
