"""Text, hashing and flag expressions. Native wherever Spark has the semantics; Arrow batches for NFKC, case folding and
shingles, where regular expressions take ten times as long."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

#: White space of the path without Python; the exact path is the UDF.
SPACE = r"(?U)[\s\x1c-\x1f]+"

#: A character outside this set may change under NFKC, or fold in another way than to lower case (ß apart).
SPECIAL = r"[^\x00-\x7f¡§©«¬®°±¶·»¿À-ÿ–—‘-„†-•€、。一-\x{9fff}]"

# Patterns of contact data and credentials, by flag, in order.
FLAGS = {
    "credential_pattern": r"\b(?:sk-[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9_]{12,})\b",
    "email": r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}",
    "ip_address": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])",
    "mobile_number": r"(?<!\d)1[3-9]\d{9}(?!\d)",
}
#: Shortest text that identifies a document or a first prompt.
ANCHOR_CHARS = 80


def normal_form(text: str) -> str:
    """NFKC, runs of white space as one space, stripped, case-folded."""
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


def folded_form(text: str) -> str:
    """Case-folded first, then white space: the form of candidate names."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(StringType())
def normalize(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normal_form(t))


@F.pandas_udf(StringType())
def normalize_name(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else folded_form(t))


@F.pandas_udf(ArrayType(StringType()))
def normalize_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda ts: None if ts is None else [None if t is None else normal_form(t) for t in ts])


def normalize_plain(text: Column) -> Column:
    """The normal form of text without SPECIAL characters; stays in the JVM."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "ß", "ss"), SPACE, " "))


def normal(text: Column) -> Column:
    """The normal form; null for null. The text is evaluated once."""
    return normalize(text)


def normal_all(texts: Column) -> Column:
    """normal() of each text of an array, nulls kept."""
    return normalize_each(texts)


def canonical_strings(values: Column) -> Column:
    """Canonical JSON of an array of strings."""
    return F.to_json(values)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def serialize(json: Column) -> Column:
    """JSON text in which no `<` can open a control token."""
    return F.replace(json, F.lit("<"), F.lit("\\u003c"))


def privacy_flags(text: Column) -> Column:
    """Names of the patterns that occur, in their fixed order."""
    hits = [F.when(text.rlike(("(?U)" if name == "email" else "") + p), F.lit(name)) for name, p in FLAGS.items()]
    return F.array_compact(F.array(*hits))


def script_profile(text: Column) -> Column:
    """By counts of CJK ideographs (U+3400 to U+9FFF) and Latin letters."""
    cjk = F.length(F.regexp_replace(text, "[^\\x{3400}-\\x{9fff}]", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return (
        F.when(cjk == 0, "no_cjk_not_necessarily_english").when(cjk >= latin, "cjk_dominant").otherwise("mixed_latin_dominant")
    )


def document_anchor(text: Column) -> Column:
    """The document that a prompt quotes, normalised; null where there is none of ANCHOR_CHARS at least.

    Text before the last question mark-up line, without a reading instruction; or between premise and hypothesis; or
    all lines before a last line that asks, where they have 160 characters.
    """
    question = F.regexp_replace(F.regexp_extract(text, "(?s)^(.*)\n问题[:：]", 1), "^阅读[^\n]*\n", "")
    premise = F.regexp_extract(text, "(?s)前提[:：](.*?)\n假设[:：]", 1)
    last = F.substring_index(text, "\n", -1)
    before = F.left(text, F.length(text) - F.length(last) - 1)
    asks = text.contains("\n") & last.rlike("[?？]") & (F.length(before) >= 160)
    article = (
        F.when(text.rlike("\n问题[:：]"), question)
        .when(text.rlike("前提[:：]") & text.rlike("\n假设[:：]"), premise)
        .when(asks, before)
        .otherwise("")
    )
    found = normal(article)
    return F.when(F.length(found) >= ANCHOR_CHARS, found)


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct n-character shingles of a text; a shorter text is its only shingle.

    A look-ahead finds them in one pass; low surrogates are passed over, so that none starts inside a character.
    """
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?![\\x{{DC00}}-\\x{{DFFF}}])(?=(.{{{n}}}))"), 1))
    return F.when(F.length(text) < n, F.array(text)).otherwise(found)


def shingle_hashes(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of shingles(): a polynomial of the code points, scrambled one to one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = min(n, len(points))
    out = np.full(len(points) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + points[j : len(points) - k + 1 + j]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    out = np.sort(out ^ (out >> np.uint64(31)))
    return out[np.append(True, out[1:] != out[:-1])]


def normal_shingles(text: str) -> np.ndarray:
    """shingle_hashes() of a text's normal form."""
    return shingle_hashes(normal_form(text))


@F.pandas_udf(LongType())
def count_normal_shingles(texts: pd.Series) -> pd.Series:
    """The number of distinct shingles of the normal form."""
    return texts.map(lambda t: None if t is None else len(normal_shingles(t))).astype("Int64")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def seed_of(digest_: Column) -> Column:
    """The first eight hex digits of a digest as a number."""
    return F.conv(F.substring(digest_, 1, 8), 16, 10).cast("long")


def trace_seed(seed: Column, trace: Column) -> Column:
    return F.pmod(seed + trace, F.lit(1 << 31))


def output_budget(k: Column) -> Column:
    """Tokens that an answer over k candidates may take."""
    return F.least(F.lit(24000), F.greatest(F.lit(4096), 80 * k))


def scrub(json: Column, secrets: list[str]) -> Column:
    """Serialized values without run-time secrets."""
    for s in secrets:
        json = F.replace(json, F.lit(s), F.lit("[REDACTED]"))
    return json


