"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their pattern that pass their check;
a match that fails is dropped and the search goes on behind it. The method adds IBANs (mod-97), short cards and local
phone numbers where a context word stands near, and secrets in assignments. Base spans always stay.

Every search is linear in the text, also where the plain pattern isn't: addresses are found from their `@`, dotted
numbers from maximal digit chains. Texts are handled whole in Arrow batches; no state is kept between rows.

Defined results: null text counts as empty and has no spans; repeated rows give repeated rows; very long texts are searched
whole; of spans that start together the longest names what is masked; an empty table gives an empty result; masked text
equals the text where nothing was found; only the columns asked for are read, whatever others are called.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DIGIT = re.compile("[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,34}\b")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z-])")
_VALUE = re.compile(r"[:=]\s{0,3}[\"']?([A-Za-z0-9+/_=-]{16,})")
_NAMED = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}$")

# Words that make a doubtful number likelier to be of a kind.
CONTEXT = {
    "card": ("amex", "card", "credit", "debit", "mastercard", "payment", "visa"),
    "phone": ("call", "cell", "contact", "fax", "mobile", "phone", "tel", "telephone"),
    "iban": ("account", "bank", "iban", "konto", "transfer"),
}
#: Characters before a span that count as near.
NEAR = 40
#: A doubtful span is kept from this score.
KEEP_SCORE = 0.6


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            last = m.end()
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CHAIN.finditer(text):
        if text.count(".", m.start(), m.end()) < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                out.append((at, end))
            at = end + 1
    return out


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            yield m.start(), m.end(), m[0].replace(" ", "").replace("-", "")


def phones(text: str) -> list[tuple[int, int]]:
    found = _PHONE.finditer(text) if "+" in text else ()
    return [m.span() for m in found if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


def ibans(text: str) -> list[tuple[int, int]]:
    """Longest stretch of whole groups from each candidate's start that has an IBAN's length and check digits."""
    out = []
    for m in _IBAN.finditer(text):
        groups = m[0].split(" ")
        for n in range(len(groups), 0, -1):
            if 15 <= len(plain := "".join(groups[:n])) <= 34 and mod97(plain):
                out.append((m.start(), m.start() + len(" ".join(groups[:n]))))
                break
    return out


def secrets(text: str) -> list[tuple[str, int, int, float]]:
    found = _VALUE.finditer(text) if "=" in text or ":" in text else ()
    return [("secret", *m.span(1), 0.9) for m in found if _NAMED.search(text, max(0, m.start() - 20), m.start())]


def _near(text: str, start: int, kind: str) -> bool:
    before = text[max(0, start - NEAR) : start].lower()
    return any(re.search(rf"\b{w}\b", before) for w in CONTEXT[kind])


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points; base kinds first, each kind by start."""
    out = [("email", *s, 0.95) for s in emails(text)]
    if not _DIGIT.search(text):
        return out + secrets(text)
    out += [("ip", *s, 0.8) for s in addresses(text)]
    more = []
    for start, end, digits in _numbers(text):
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", start, end, 0.8 + 0.15 * _near(text, start, "card")))
        elif 13 <= len(digits) <= 15 and digits[0] in "3456" and luhn(digits):
            more.append(("card_short", start, end, 0.4 + 0.4 * _near(text, start, "card")))
    out += [("phone", *s, 0.8 + 0.15 * _near(text, s[0], "phone")) for s in phones(text)]
    more += [("iban", *s, 0.85 + 0.1 * _near(text, s[0], "iban")) for s in ibans(text)]
    taken = sorted(s[1:3] for s in out)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for m in _LOCAL_PHONE.finditer(text):
        # of the spans that start before this one ends, the furthest end decides
        k = bisect_left(starts, m.end())
        if not k or ends[k - 1] <= m.start():
            more.append(("phone_local", *m.span(), 0.3 + 0.4 * _near(text, m.start(), "phone")))
    return out + sorted([s for s in more if s[3] >= KEEP_SCORE] + secrets(text))


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """text with each found stretch replaced by its kind; of overlapping spans the first, longest names the stretch."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


_FOUND = pa.struct(
    [(f"n_{k}", pa.int64()) for k in BASE]
    + [("n_spans", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("min_score", pa.float64()), ("masked", pa.string())]
)


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, n_email, n_ip, n_card, n_phone, n_spans (of all kinds), base_sha256, spans, min_score and, if asked, masked."""
    fields = [f for f in _FOUND if with_text or f.name != "masked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                body = value or ""
                spans = find(body)
                base = [s for s in spans if s[0] in BASE]
                row = {f"n_{k}": sum(s[0] == k for s in base) for k in BASE}
                row["n_spans"] = len(spans)
                row["base_sha256"] = hashlib.sha256(_joined(base).encode()).hexdigest()
                row["spans"] = _joined(spans)
                row["min_score"] = min((s[3] for s in spans), default=None)
                if with_text:
                    row["masked"] = None if value is None else masked(body, spans)
                rows.append(row)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array([r[f.name] for r in rows], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = {f.name: "bigint" if f.name.startswith("n_") else "double" if f.name == "min_score" else "string" for f in fields}
    names = ["doc_id", *keep, *kinds]
    source = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("_text"))
    types = dict(source.dtypes)
    schema = ", ".join(f"`{c}` {types.get(c) or kinds[c]}" for c in names)
    return source.mapInArrow(run, schema)
