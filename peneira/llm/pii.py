"""Personal data: patterns propose, checksums confirm, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import whole_text
from peneira.llm.encoding import texts

# Kinds in their order and their patterns. ``iban`` is added to the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A start inside a run of digits fails whenever its first digit does, so only first digits are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
# Characters of an account number by country, as registered.
_IBAN_LENGTHS = {
    c: int(n)
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}
_NOT_DIGITS = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7}
CONTEXT_CHARS = 60
CONTEXT_SCORE = 0.2
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|correo|kontakt)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|adresse)\b"),
    "card": re.compile(r"(?i)\b(?:card|credit|debit|visa|mastercard|carte|karte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b"),
}


def luhn(digits: str) -> bool:
    """Whether the last digit makes the weighted sum a multiple of ten."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the account number with its head moved to the end leaves 1 modulo 97."""
    compact = iban.replace(" ", "")
    moved = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans of account numbers; what follows in blank-separated capitals or digits is no part of them.

    A candidate ends where one of its groups ends: at its country's length, else as far as it
    reaches, else, for a country not listed, at the last group end that is valid. After one
    that is not valid the search goes on behind its first character.
    """
    at = 0
    while m := _IBAN.search(text, at):
        start, ends = m.start(), [k for k in range(m.end(), m.start() + 14, -1) if k == m.end() or text[k] == " "]
        length = _IBAN_LENGTHS.get(text[start : start + 2])
        sized = [k for k in ends if k - start - text.count(" ", start, k) == length]
        tried = [*sized, ends[0]] if length else ends
        end = next((k for k in tried if mod97(text[start:k])), None)
        if end:
            yield start, end
        at = end or start + 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, leftmost first: tried only where an @ stands.

    A match begins at the first character of the run before its @ that no earlier match took.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield found.span()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _digits(value: str) -> str:
    return _NOT_DIGITS.sub("", value)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """``kind, start, stop, score`` of all confirmed spans, by kind as listed, then start."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    found += [("iban", a, b) for a, b in _ibans(text)]
    return [(kind, a, b, _score(text, kind, a, b)) for kind, a, b in found]


def _score(text: str, kind: str, start: int, stop: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[stop : stop + CONTEXT_CHARS]
    return round(min(1.0, BASE_SCORE[kind] + CONTEXT_SCORE * bool(CONTEXT[kind].search(near))), 2)


_SPANS = "array<struct<kind: string, start: long, stop: long, value: string, score: double>>"
_ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string()), ("score", pa.float64())])
)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found`` of every row: spans with kind, place (code points), value and score.

    Null and empty texts have no spans; repeated rows are searched and returned each; an
    empty table gives no rows; other columns are ignored. Texts are searched whole, each
    where it is read.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in texts(batches):
            rows = [
                [{"kind": k, "start": a, "stop": b, "value": t[a:b], "score": s} for k, a, b, s in find_spans(t)]
                for t in words
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, _ARROW_SPANS)], ["doc_id", "found"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return chosen.mapInArrow(search, f"doc_id long, found {_SPANS}")


def document_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row, from ``personal_data``."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return personal_data(docs).select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        F.aggregate("found", F.lit(0.0), lambda acc, s: acc + s["score"]).alias("score_sum"),
    )
