"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkite.llm.textcodes import chunks

KINDS = ("email", "ip", "card", "phone")  # base kinds, in the order of results
EXTRA = ("iban", "short_card", "national_id")
KEPT_FROM = 0.5  # score at which a span of an extra kind counts

# A match of these begins where its run of digits begins, so scanning stays linear on long runs.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")

# Words near a span that speak for or against its kind.
CONTEXT = {
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "short_card": ("card", "visa", "amex", "credit", "payment", "karte", "carte", "tarjeta"),
    "national_id": ("ssn", "social security", "tax id", "national id"),
}
AGAINST = ("order", "invoice", "isbn", "serial", "version", "tracking")
WINDOW = 48  # characters looked at on either side


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number, its country and check digits moved to the end, leaves 1."""
    plain = code.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def plain_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outward: the local part is the run before it, from the last match on."""
    done = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > done and LOCAL.match(text, first - 1, first):
            first -= 1
        found = DOMAIN.match(text, at + 1) if first < at else None
        if found:
            done = found.end()
            yield first, done
        at = text.find("@", max(at + 1, done))


def context_score(text: str, kind: str, start: int, end: int, base: float) -> float:
    near = text[max(0, start - WINDOW) : start].lower() + " " + text[end : end + WINDOW].lower()
    score = base + 0.35 * any(w in near for w in CONTEXT.get(kind, ())) - 0.35 * any(w in near for w in AGAINST)
    return min(1.0, max(0.0, score))


def base_spans(text: str) -> list[Span]:
    out = [Span("email", a, b, 1.0) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                out.append(Span("ip", m.start(), m.end(), 1.0))
        for m in CARD.finditer(text):
            number = plain_digits(m[0])
            if 16 <= len(number) <= 19 and luhn(number):
                out.append(Span("card", m.start(), m.end(), 1.0))
        if "+" in text:
            out += [Span("phone", m.start(), m.end(), 1.0) for m in PHONE.finditer(text) if 8 <= len(plain_digits(m[0])) <= 15]
    return out


def find_spans(text: str | None) -> list[Span]:
    """All spans, by kind in order, then start. Base kinds always stay; extra kinds need their score."""
    if not text:
        return []
    out = base_spans(text)
    if DIGIT.search(text):
        for m in IBAN.finditer(text):
            if mod97(m[0]):
                out.append(Span("iban", m.start(), m.end(), context_score(text, "iban", m.start(), m.end(), 0.8)))
        for m in CARD.finditer(text):
            number = plain_digits(m[0])
            if 13 <= len(number) <= 15 and luhn(number):
                out.append(Span("short_card", m.start(), m.end(), context_score(text, "short_card", m.start(), m.end(), 0.3)))
        for m in NATIONAL.finditer(text):
            out.append(Span("national_id", m.start(), m.end(), context_score(text, "national_id", m.start(), m.end(), 0.3)))
    return [s for s in out if s.kind in KINDS or s.score >= KEPT_FROM]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind; overlapping spans are replaced together."""
    if not text or not spans:
        return text
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"<{s.kind}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


SPAN_TYPE = "array<struct<kind: string, start: int, end: int, score: double>>"


def detect(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
           with_redacted: bool = False) -> DataFrame:
    """The columns ``keep`` with ``pii_spans`` (kind, start, end in code points, score), on demand ``redacted``.

    Null texts have no span and stay null. Whole texts are searched; repeated rows are each answered.
    """
    text = "pii_text"
    while text in keep:
        text += "_"
    source = docs.select(*keep, F.col(text_col).cast("string").alias(text))
    schema = source.drop(text).schema
    out = T.StructType([*schema.fields, *T._parse_datatype_string(
        f"pii_spans {SPAN_TYPE}" + ", redacted string" * with_redacted).fields])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            texts = batch.column(text).to_pylist()
            found = [find_spans(t) for t in texts]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns.append(pa.array([[vars(s) for s in spans] for spans in found], kind))
            if with_redacted:
                columns.append(pa.array([redact(t, s) for t, s in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return source.mapInArrow(run, out)


def digest(detected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the hash of the base spans' list, and the list of all spans."""
    item = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    is_base = lambda s: s["kind"].isin(*KINDS)
    of_kind = lambda kind: lambda s: s["kind"] == kind
    spans = F.col("pii_spans")
    return detected.select(
        id_col,
        *[F.size(F.filter(spans, of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(F.filter(spans, is_base), item), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, item), ",").alias("spans"),
    )

