"""Personal data: patterns propose spans, checksums confirm them, context words set the score.

Kinds `email ip card phone` are the base kinds: every match that passes its own check is
a finding whatever its score.  The method adds `iban` spans (mod-97), and `ssn` spans that
only count when a context word stands near.  Matches of one kind never overlap; ties in
start sort by the order of KINDS.  Offsets are code points.

Nulls and empty texts have no findings.  Rows that repeat, and rows with equal or null
ids, are read each by itself.  Every pattern reads a text in time in proportion to its
length, whatever runs of digits or letters it has, so very long texts are read whole.  An
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_stage, id_and_text

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
SCHEMA = "doc_id long, findings array<struct<kind:string,start:int,end:int,score:double>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts at the first digit of a run and takes runs whole, so no run is read twice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
#: Characters of 19 digits with separators.
_CARD_MOST = 37
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Words that make a kind likelier within WINDOW characters of a span.
CONTEXT = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security", "tax"),
}
WINDOW = 48
#: Score of a span whose checks pass, and what a near context word adds.
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.35}
BOOST = 0.2
_context = {k: re.compile(r"(?i)\b(?:" + "|".join(w) + r")") for k, w in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: the country and check digits move to the end, letters count from 10."""
    text = iban.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _emails(text: str):
    """Leftmost matches: each @ with a domain, and the local characters before it back to the last match."""
    last = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            yield begin, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str | None, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """Findings of one text in order of start, then kind."""
    if not text:
        return []
    out = []

    def add(kind: str, start: int, end: int, always: bool) -> None:
        near = text[max(0, start - WINDOW) : start] + " \0 " + text[end : end + WINDOW]
        score = BASE_SCORE[kind] + BOOST * bool(_context[kind].search(near))
        if always or score >= threshold:
            out.append((kind, start, end, round(score, 2)))

    for start, end in _emails(text):
        add("email", start, end, True)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            add("ip", m.start(), m.end(), True)
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= _CARD_MOST and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            add("card", m.start(), m.end(), True)
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                add("phone", m.start(), m.end(), True)
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            add("iban", m.start(), m.end(), False)
    if "-" in text:
        for m in _SSN.finditer(text):
            add("ssn", m.start(), m.end(), False)
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0])))


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _batches(batches, threshold: float):
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end", "score"), f)) for f in find(t, threshold)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _TYPE)], names=["doc_id", "findings"])


def find_personal_data(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, findings): one row for each row of docs; base kinds always stay, others from the threshold on."""
    return arrow_stage(id_and_text(docs, id_col, text_col), lambda b: _batches(b, threshold), SCHEMA)
