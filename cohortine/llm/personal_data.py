"""Personal data in whole texts: patterns propose spans, checksums confirm them, context words adjust their score.

Base kinds (email, ip, card, phone) stand wherever their pattern and checks hold; their score only tells how sure the find
is. Further kinds are looser patterns: a checksum (mod 97 for account numbers) or a telling word near them must lift their
score to LEAST_SCORE, and words that tell of something else lower it. They never overlap a base span nor one another.

Every pattern is linear in the text: runs are taken whole (possessive) and start only where a run starts, or, for addresses,
at their `@`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "tel", "secret")
LEAST_SCORE = 0.5
#: Code points before and after a span in which context words count.
BEFORE, AFTER = 48, 24

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W_]+")


class Loose(NamedTuple):
    """A further kind: its pattern, the score without any evidence, and what a checksum or a near word adds."""

    kind: str
    pattern: re.Pattern[str]
    score: float
    words: frozenset[str]


_LOOSE = (
    Loose("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"), 0.2, frozenset("iban account konto cuenta compte bank bic swift".split())),
    Loose("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0.3, frozenset("ssn social security insurance taxpayer".split())),
    Loose("tel", re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"), 0.3, frozenset("phone tel telephone call mobile fax telefon telefono appelez whatsapp".split())),
    Loose("secret", re.compile(r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{16,128}(?![0-9A-Za-z_-])"), 0.2, frozenset("token secret password passwd apikey key bearer credential credentials".split())),
)
_CONTEXT = {
    "email": frozenset("email mail contact write".split()), "ip": frozenset("ip address host server login client".split()),
    "card": frozenset("card visa mastercard credit debit payment karte tarjeta carte".split()), "phone": frozenset("phone tel telephone call mobile fax telefon".split()),
} | {x.kind: x.words for x in _LOOSE}
_AGAINST = {
    "ip": frozenset("version release section chapter".split()), "card": frozenset("order invoice isbn tracking serial".split()),
    "secret": frozenset("sha1 sha256 md5 commit checksum digest hash".split()), "tel": frozenset("order invoice isbn version".split()),
    "ssn": frozenset("order invoice part isbn".split()),
}
_BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7}
_NEAR, _CHECKED, _OFF = 0.4, 0.7, 0.3


def luhn(digits: str) -> bool:
    """Whether a number ends in its Luhn check digit."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(divmod(2 * int(d), 10)[0] + 2 * int(d) % 10 for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number (letters and digits, no spaces) leaves 1 when divided by 97."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        start = at
        while start > free:  # the longest run before the sign, a bounded step at a time
            step = max(free, start - 64)
            run = _LOCAL.match(text[step:start][::-1]).end()
            start -= run
            if run < start + run - step:
                break
        if start < at:
            free = m.end()
            yield start, free


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, each leftmost and without overlaps of its own kind."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def _near(text: str, start: int, end: int) -> set[str]:
    return set(_WORD.findall(text[max(0, start - BEFORE) : start].lower() + " " + text[end : end + AFTER].lower()))


def _adjusted(score: float, kind: str, near: set[str]) -> float:
    score += _NEAR if near & _CONTEXT[kind] else 0
    return min(1.0, max(0.0, score - (_OFF if near & _AGAINST.get(kind, frozenset()) else 0)))


def _loose_score(kind: Loose, found: str, near: set[str]) -> float:
    score = kind.score
    if kind.kind == "iban":
        plain = found.replace(" ", "")
        score += _CHECKED if 15 <= len(plain) <= 34 and mod97(plain) else 0
    if kind.kind == "ssn" and (found[:3] in ("000", "666") or found[0] == "9" or found[4:6] == "00" or found[7:] == "0000"):
        return 0.0
    if kind.kind == "secret":
        if not (re.search("[0-9]", found) and re.search("[A-Za-z]", found)):
            return 0.0
    return _adjusted(score, kind.kind, near)


def spans_of(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of every find, by start, then kind as listed, then end."""
    base = base_spans(text)
    out = [(a, b, k, _adjusted(_BASE_SCORE[k], k, _near(text, a, b))) for a, b, k in base]
    offers = []
    for number, kind in enumerate(_LOOSE):
        for m in kind.pattern.finditer(text):
            score = _loose_score(kind, m.group(), _near(text, m.start(), m.end()))
            if score >= LEAST_SCORE:
                offers.append((-score, m.start(), number, m.end(), kind.kind))
    if offers:
        starts, ends = [], []  # disjoint stretches that are taken
        for a, b, _ in sorted(base):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        for score, a, _, b, kind in sorted(offers):
            at = bisect_left(starts, b)
            if not at or ends[at - 1] <= a:
                starts.insert(at, a)
                ends.insert(at, b)
                out.append((a, b, kind, -score))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of each row: start, end (exclusive, in code points), kind and score of each find in its whole text.

    A null text is empty. Every row gives one row, rows that repeat a doc_id or have none included. Other columns are not read.
    """
    fields = [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, flat = [0], []
            for text in batch.column(1):
                flat += spans_of(text.as_py() or "")
                sizes.append(len(flat))
            columns = zip(*flat, strict=True) if flat else [()] * 4
            struct = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], fields=[pa.field(*f) for f in fields])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), struct)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, spans array<struct<start:int,end:int,kind:string,score:double>>")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every find in `text` replaced by its kind in square brackets; where finds overlap, by that of the first.
    Null texts stay null, other columns pass through."""

    place = docs.columns.index("text")
    plain = docs.toDF(*(f"c{n}" for n in range(len(docs.columns))))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(place).to_pylist():
                parts, at = [], 0
                for a, b, kind, _ in spans_of(text or ""):
                    if b > at:
                        parts += [text[at:a], f"[{kind}]"] if a >= at else []
                        at = b
                texts.append(None if text is None else "".join(parts) + text[at:])
            yield batch.set_column(place, batch.schema.names[place], pa.array(texts, pa.string()))

    return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs the number of finds of each base kind, a digest of the base finds, all finds, and the best score."""
    found = find(docs)
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    only = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *(F.size(only(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(told(only(*BASE)), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
