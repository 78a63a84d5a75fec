"""Masking of conversation states: equal values of a category share one numbered placeholder over the whole state."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as S

# Categories and patterns, in the order of their application.
PATTERNS = (
    ("TOKEN", r"\b(?:sk-[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9_]{12,})\b"),
    ("CREDENTIAL", r"(?i)\b(?:password|passwd|api[_-]?key|access[_-]?token)\s*[:=]\s*[\x22\x27]?[^\s,;\x22\x27]+"),
    ("EMAIL", r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"),
    ("IP", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"),
    ("PHONE", r"(?<!\d)1[3-9]\d{9}(?!\d)"),
    ("PATH", r"(?<![\w.])/(?:home|Users|data|mnt|root)/[^\s\x22\x27<>]+"),
    ("PATH", r"[A-Za-z]:\\(?:Users|Documents and Settings)\\[^\s\x22\x27<>]+"),
    ("URL_AUTH", r"https?://[^\s/@:]+:[^\s/@]+@[^\s]+"),
)
#: Categories whose presence excludes a prefix from export.
EXCLUDING = ("TOKEN", "CREDENTIAL", "URL_AUTH")
_COMPILED = [(name, re.compile(p)) for name, p in PATTERNS]


class Masker:
    """Placeholders of one state."""

    def __init__(self) -> None:
        self.names: dict[tuple[str, str], str] = {}
        self.counts: Counter = Counter()

    def mask(self, text: str) -> str:
        for category, pattern in _COMPILED:
            text = pattern.sub(lambda m, c=category: self._name(c, m[0]), text)
        return text

    def _name(self, category: str, value: str) -> str:
        if (category, value) not in self.names:
            self.counts[category] += 1
            self.names[category, value] = f"[REDACTED_{category}_{self.counts[category]}]"
        return self.names[category, value]


def sanitize(roles: list[str], texts: list[str]) -> tuple[list[str], dict[str, int]]:
    if not roles or roles[-1] != "user":
        raise ValueError("a prefix ends with a user's message")
    masker = Masker()
    return [masker.mask(t) for t in texts], dict(masker.counts)


_SANITIZED = S.StructType(
    [
        S.StructField("texts", S.ArrayType(S.StringType())),
        S.StructField("counts", S.MapType(S.StringType(), S.LongType())),
        S.StructField("excluded", S.BooleanType()),
    ]
)


@F.pandas_udf(_SANITIZED)
def sanitize_state(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """Masked texts of a state, distinct values by category, and whether the state must be left out."""
    rows = []
    for r, t in zip(roles, texts, strict=True):
        masked, counts = sanitize(list(r), list(t))
        rows.append({"texts": masked, "counts": counts, "excluded": any(c in counts for c in EXCLUDING)})
    return pd.DataFrame(rows, columns=["texts", "counts", "excluded"])
