"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table

BASE = ("email", "ip", "card", "phone")
#: Kinds that context and checksums add to the base kinds.
ADDED = ("iban", "local_phone", "short_card", "secret")
KINDS = BASE + ADDED
#: Scores are in tenths. A span of an added kind counts from the threshold on.
THRESHOLD = 6
#: What form and check give: both, or the form alone.
SCORES = {"iban": (7, 1), "local_phone": (6, 3), "short_card": (4, 1), "secret": (4, 1)}
#: What words nearby add: one of the kind, two or more different ones, and one that speaks of things rather than people.
ONE, SEVERAL, AGAINST = 4, 5, -3
NEAR = 48  # characters before or after a span in which a word counts as nearby

# Each pattern starts where no earlier character could belong to the match, so no text takes quadratic time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}(?![A-Za-z0-9])")
_WORDS = {
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "local_phone": re.compile(r"\b(?:phone|call|tel|telephone|mobile|fax|contact|telefon|teléfono)\b", re.I),
    "short_card": re.compile(r"\b(?:card|visa|amex|credit|karte|carte|tarjeta)\b", re.I),
    "secret": re.compile(r"\b(?:token|secret|key|password|apikey|passwd|bearer)\b", re.I),
}
_THINGS = re.compile(r"\b(?:part|parts|sku|serial|model|isbn|issn|order|version|build|checksum|hash|sha1|sha256|md5|digest|commit|uuid)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of account numbers: country and check digits last, letters as 10 to 35, remainder 1."""
    body = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans that always count, by kind: leftmost matches, those that fail their check dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def _nearby(kind: str, text: str, start: int, end: int) -> int:
    """What the words before and after a span add to its score."""
    windows = (max(0, start - NEAR), start), (end, end + NEAR)
    words = {w.lower() for a, b in windows for w in _WORDS[kind].findall(text, a, b)}
    against = any(_THINGS.search(text, a, b) for a, b in windows)
    return (0, ONE, SEVERAL)[min(len(words), 2)] + AGAINST * against


def scored(text: str) -> Iterator[tuple[str, int, int, int]]:
    """Proposed spans of the added kinds with their scores: kind, start, end, tenths. A check that fails can be outweighed by two
    words nearby, one that holds by a word against it."""

    def score(kind: str, m: re.Match, sure: bool) -> tuple[str, int, int, int]:
        return kind, *m.span(), SCORES[kind][0 if sure else 1] + _nearby(kind, text, *m.span())

    for m in _IBAN.finditer(text):
        yield score("iban", m, mod97(m[0]))
    for m in _LOCAL_PHONE.finditer(text):
        d = re.sub("[^0-9]", "", m[0])  # in brackets, and neither area nor exchange begins with 0 or 1
        yield score("local_phone", m, m[0].startswith("(") and ")" in m[0] and d[0] > "1" and d[3] > "1")
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 29 and 13 <= len(d := re.sub("[ -]", "", m[0])) <= 15:
            yield score("short_card", m, luhn(d))
    for m in _SECRET.finditer(text):
        yield score("secret", m, any(map(str.isdigit, m[0])))


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """All spans by kind. An added span that touches a base span gives way."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS} | base_spans(text)
    taken = sorted(s for k in BASE for s in out[k])
    starts = [a for a, _ in taken]
    ends = list(accumulate((b for _, b in taken), max))  # the furthest end so far
    for kind, start, end, score in scored(text):
        before = bisect_left(starts, end)  # spans that begin before this one ends
        if score >= THRESHOLD and (not before or ends[before - 1] <= start):
            out[kind].append((start, end))
    return out


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(found[k]))


def redact(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with each stretch of spans replaced by the kind of its first span."""
    out, done, stretch = [], 0, None
    for start, end, kind in sorted((a, b, k) for k in found for a, b in found[k]):
        if stretch and start < stretch:
            stretch = max(stretch, end)
            done = stretch
            continue
        out += [text[done:start], f"<{kind.upper()}>"]
        done = stretch = end
    return "".join(out) + text[done:]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> for the base kinds, base and spans as text: kind:start:end in code points, comma-joined.

    Null and empty texts have none. Each row is judged alone: repeated rows give the same, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(x or "") for x in batch.column("text").to_pylist()]
            counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE]
            joined = [pa.array([listed(f, k) for f in found], pa.string()) for k in (BASE, KINDS)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *joined], ["doc_id", *(f"n_{k}" for k in BASE), "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in text replaced by their kinds, and n_chars, where it is there, counted anew.

    Null and empty texts stay. Each row is changed alone: repeated rows stay repeated, an empty table gives no rows.
    """
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [None if x is None else redact(x, spans(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document."""
    found = find(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2("base", 256).alias("base_sha256"), "spans")


