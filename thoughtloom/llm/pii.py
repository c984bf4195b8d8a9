"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns and are kept whenever their own test
holds, whatever their score. Further kinds are kept from a score of ``KEEP`` on: an IBAN whose
mod-97 check holds, and numbers (a national id, a phone number without "+", a passport) that need
a context word near them, since their shape alone says little.

Offsets are code points, ends are exclusive. Texts are read whole, and every pattern advances over
a text in time that is linear in its length: none can start inside a run that it has just failed
on. A null or empty text has no span. Repeated rows each get their spans; null ids are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "local_phone", "passport")
KINDS = BASE + ADDED
#: Score from which an added span is kept, and how far away a context word counts.
KEEP, NEAR = 0.7, 48

#: Prior of a span whose checksum (where there is one) holds; a context word adds CONTEXT.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.4, "local_phone": 0.4, "passport": 0.3}
CONTEXT = 0.4
WORDS = {
    "email": "mail email e-mail contact correo courriel",
    "ip": "ip address host server login",
    "card": "card credit visa mastercard amex payment karte tarjeta carte",
    "phone": "phone tel telephone call mobile fax telefon móvil",
    "iban": "iban account bank konto cuenta compte",
    "national_id": "ssn social security",
    "local_phone": "phone tel telephone call mobile fax telefon",
    "passport": "passport reisepass passeport pasaporte",
}
_CONTEXT = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, v.split())) + r")(?!\w)", re.IGNORECASE) for k, v in WORDS.items()}

_AT = re.compile("@")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_PASSPORT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each "@": the run of local characters before it and the longest domain after it."""
    done = 0
    for at in _AT.finditer(text):
        place = at.start()
        if place < done:
            continue
        start = place
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < place and (domain := _DOMAIN.match(text, place + 1)):
            yield start, (done := domain.end())


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        yield from (("email", a, b) for a, b in _emails(text))
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield "phone", m.start(), m.end()


def _added(text: str) -> Iterator[tuple[str, int, int]]:
    if not _DIGIT.search(text):
        return
    for m in _IBAN.finditer(text):
        compact = m.group().replace(" ", "")
        if 15 <= len(compact) <= 34 and mod97(compact):
            yield "iban", m.start(), m.end()
    for kind, pattern in (("national_id", _NATIONAL), ("local_phone", _LOCAL_PHONE), ("passport", _PASSPORT)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def find_spans(text: str | None) -> list[Span]:
    """All spans of one text, by kind as in KINDS, then start."""
    if not text:
        return []
    found = []
    for kept, proposals in ((True, _base(text)), (False, _added(text))):
        for kind, start, end in proposals:
            near = _CONTEXT[kind].search(text, max(0, start - NEAR), start) or _CONTEXT[kind].search(text, end, end + NEAR)
            score = min(1.0, PRIOR[kind] + (CONTEXT if near else 0.0))
            if kept or score >= KEEP:
                found.append(Span(kind, start, end, score))
    return sorted(found, key=lambda s: (KINDS.index(s.kind), s.start))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def detect(docs: DataFrame, text: str = "text", column: str = "spans") -> DataFrame:
    """``docs`` without its text, with its spans as ``column``: array of (kind, start, end, score)."""
    keep = [f for f in docs.schema.fields if f.name not in (text, column)]
    names = [f.name for f in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{column}` array<struct<kind:string,start:int,end:int,score:double>>"])

    def run(batches):
        for batch in batches:
            spans = [[s._asdict() for s in find_spans(t.as_py())] for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(spans, type=_SPANS)], names=[*names, column])

    return docs.select(*(F.col(f"`{c}`") for c in [*names, text])).mapInArrow(run, schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda span: span["kind"] == kind


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
