"""Personal data in texts: regular expressions propose, checksums confirm, nearby words adjust.

Base kinds, always reported: email, ip (parts up to 255), card (13 to 19 digits, Luhn) and phone (`+`,
9 to 15 digits). Added kinds: iban (mod-97), and numbers that only their surroundings tell
apart: national (nnn-nn-nnnn) and local_phone ((nnn) nnn-nnnn without a country code). Every span has a
score: its kind's, more if a context word of the kind stands within 40 characters before it, less
if a word does that marks other numbers. Added spans count from a score of 0.5 on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local_phone", "national")
KINDS = (*BASE, *ADDED)
THRESHOLD, CONTEXT_CHARS, STEP = 0.5, 40, 0.3

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+)\x20])\x20?\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
WORD = re.compile(r"[^\W\d_]+")

SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "local_phone": 0.3, "national": 0.3}
FOR = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "visa", "credit", "mastercard", "karte", "tarjeta", "carte"},
    "phone": {"phone", "tel", "call", "mobile", "telefon", "fax", "teléfono", "téléphone"},
    "iban": {"iban", "account", "bank", "konto", "cuenta", "compte"},
    "local_phone": {"phone", "tel", "call", "mobile", "telefon", "fax"},
    "national": {"ssn", "social", "security"},
}
AGAINST = {"version", "isbn", "order", "invoice", "serial", "model"}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, digits summed, is a multiple of ten."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod97(account: str) -> bool:
    """The first four signs moved to the end, letters as 10 to 35: leaves 1 when divided by 97."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping. Goes from one `@` to the next, so that a long run of letters
    without one is passed once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > done and (text[first - 1].isascii() and (text[first - 1].isalnum() or text[first - 1] in "._%+-")):
            first -= 1
        domain = DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            yield first, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers, leftmost, not overlapping; the parts at most 255."""
    for run in DOTTED.finditer(text):
        start, parts = run.start(), []
        for part in [*run[0].split("."), ""]:
            if part:
                parts.append(part)
                if len(parts) == 4:
                    end = start + sum(map(len, parts)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                        yield start, end
                    start, parts = end + 1, []
            else:
                start += sum(len(p) + 1 for p in parts) + 1
                parts = []


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of all kinds."""
    for start, end in emails(text):
        yield "email", start, end
    if not DIGIT.search(text):
        return
    for start, end in addresses(text):
        yield "ip", start, end
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 37 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield "iban", m.start(), m.end()
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", m.end() - 14, m.end()
    for m in NATIONAL.finditer(text):
        yield "national", m.start(), m.end()


def find(text: str | None) -> list[Span]:
    """All spans of a text (none of a null), by kind as listed and start; offsets in code points."""
    spans = []
    for kind, start, end in propose(text or ""):
        near = {w.lower() for w in WORD.findall(text[max(0, start - CONTEXT_CHARS) : start])}
        score = SCORE[kind] + STEP * bool(near & FOR[kind]) - STEP * bool(near & AGAINST)
        if kind in BASE or score >= THRESHOLD:
            spans.append(Span(kind, start, end, round(min(max(score, 0.0), 1.0), 2)))
    return sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SPANS_SCHEMA = "array<struct<kind: string, start: int, end: int, score: double>>"


def detect(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) as doc_id and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct(
            [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]
        )
        for batch in batches:
            found = [[s._asdict() for s in find(t)] for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.list_(kind))], names=["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, spans {SPANS_SCHEMA}")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones the first."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"<{s.kind}>"]
            done = s.end
    return "".join([*out, text[done:]])


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
