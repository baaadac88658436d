"""Secrets in whole texts, and parts of credentials that stand together.

Three kinds stand for themselves: an assignment to a secret's name, an access key identifier, a hexadecimal run. Weaker
signs (short assigned values, mixed tokens, names of accounts, addresses of services) are reported only with a
complementary part: a secret goes with an identifier or an endpoint, an identifier or endpoint with a secret. They
must be in one scope (a block without a blank line), at most ``REACH`` code points apart, and no part of one another: a
digest inside an address is no secret that the address opens. User, password and host that an address spells out are
parts of their own. This interval join counts by bisection of the sorted begins and ends of a scope, those in reach
less those that overlap, so no pairs are made, however many parts a text has.

Defined cases: a null text counts as empty and has no spans; a row is answered for each row, also for rows that
repeat; an empty table gives none. Only ``doc_id`` and ``text`` are read. A text is searched as a whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import small

#: Code points between two parts of a credential at most.
REACH = 400
#: Kinds in the order of spans that begin together; the first three are the base.
KINDS = ("assign", "access", "hex", "weak_secret", "identifier", "endpoint")
#: Parts that go together.
PARTNERS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}
ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
IDENTIFIER = re.compile(r"""(?ai)\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""")
MAIL = re.compile(r"(?a)[\w.+-]{1,64}@[\w-]+(?:\.[\w-]+)+")
ADDRESS = re.compile(r"""(?ai)\b[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+""")
HOST = re.compile(r"""(?ai)\b(?:host(?:_?name)?|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9:/_.-]{3,}""")
#: User, password and host in an address.
LOGIN = re.compile(r"""(?a)://([^\s:/@"'<>]{1,64}):([^\s/@"'<>]{6,})@([^\s:/@"'<>]+)""")
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")
#: An assigned value of fewer characters is weak; of fewer than WEAK none.
STRONG, WEAK = 12, 6

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """Begin, number of the kind and end of the base spans."""
    spans = [(m.start(), 0, m.end()) for m in assigned(text) if len(m[2]) >= STRONG]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def assigned(text: str) -> Iterator[re.Match]:
    return ASSIGN.finditer(text) if "=" in text or ":" in text else iter(())


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates that need a partner. A mixed token has capitals, small letters and digits, and is in no base span."""
    spans = [(m.start(), 3, m.end()) for m in assigned(text) if WEAK <= len(m[2]) < STRONG]
    taken = sorted((begin, end) for begin, _, end in base)
    begins, furthest = [b for b, _ in taken], [0, *accumulate((e for _, e in taken), max)]
    for m in MIXED.finditer(text):
        token = m[0]
        if furthest[bisect_left(begins, m.end())] <= m.start() and re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token):
            spans.append((m.start(), 3, m.end()))
    if "=" in text or ":" in text:
        spans += [(m.start(), 4, m.end()) for m in IDENTIFIER.finditer(text)]
        spans += [(m.start(), 5, m.end()) for m in HOST.finditer(text)]
    if "@" in text:
        spans += [(m.start(), 4, m.end()) for m in MAIL.finditer(text)]
    if "://" in text:
        spans += [(m.start(), 5, m.end()) for m in ADDRESS.finditer(text)]
        spans += [(m.start(part), kind, m.end(part)) for m in LOGIN.finditer(text) for part, kind in ((1, 4), (2, 3), (3, 5))]
    return list(dict.fromkeys(spans))


def linked(text: str, base: list[Span], weak: list[Span], reach: int = REACH) -> tuple[list[Span], int]:
    """The weak spans that have a partner, and the number of their partners."""
    gaps = [m.start() for m in BLANK_LINE.finditer(text)]
    scopes: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for begin, kind, end in base + weak:
        scopes.setdefault((bisect_right(gaps, begin), ROLE[KINDS[kind]]), []).append((begin, end))
    sides = {at: (sorted(b for b, _ in spans), sorted(e for _, e in spans)) for at, spans in scopes.items()}
    kept, links = [], 0
    for span in weak:
        begin, kind, end = span
        scope = bisect_right(gaps, begin)
        partners = 0
        for role in PARTNERS[ROLE[KINDS[kind]]]:
            if side := sides.get((scope, role)):
                near = bisect_right(side[0], end + reach) - bisect_left(side[1], begin - reach)
                partners += near - (bisect_left(side[0], end) - bisect_right(side[1], begin))
        if partners:
            kept.append(span)
            links += partners
    return kept, links


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{begin}:{end}" for begin, kind, end in sorted(spans))


def found(text: str | None) -> dict:
    text = text or ""
    base = base_spans(text)
    kept, links = [], 0
    if weak := weak_spans(text, base):
        kept, links = linked(text, base, weak)
    count = [sum(kind == k for _, kind, _ in base) for k in range(3)]
    return {
        "n_assign": count[0], "n_access": count[1], "n_hex": count[2],
        "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
        "spans": joined(base + kept), "n_weak": len(kept), "n_links": links,
    }


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: counts and digest of the base spans, all spans, and how many weak ones are linked."""
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_weak", "n_links")
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_weak long, n_links long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [found(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[n] for r in rows], pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in names)],
                ["doc_id", *names],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
