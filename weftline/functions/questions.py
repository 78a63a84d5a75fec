"""Question drafts, reviews and records as JSON text: strict validation with reasons, in Arrow UDFs.

A check is a list of (reason, whether it holds); the first one that holds is the answer. Tokens are counted by a plug-in;
words stand for them where none is given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.functions.requests import request_error
from weftline.functions.strict_json import canonical, parse_object
from weftline.functions.text import folded_form

# Fields and marks of reviews and records, limits of drafts in tokens.
REVIEW_FIELDS = {"decision", "checks", "issues", "evidence"}
CHECKS = ("grounded", "task_faithful", "scope_clear", "distinct_options", "no_answer_hints", "no_padding", "language_matches")
RECORD_FIELDS = {"schema_version", "id", "input", "input_sha256", "provenance", "recipe", "metrics", "audit", "status", "training_eligible"}
SCHEMA, STATUS, SPLIT = 1, "llm_reviewed", "train"
LIMITS = {"option": 256, "state": 6000, "path": 8192, "total": 262_144}


def count_words(text: str) -> int:
    return len(text.split())


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def draft_errors(draft: dict, state: object, kind: str, k: int, count: Callable[[str], int] = count_words, limits: dict = LIMITS) -> Iterator[tuple[str, bool]]:
    """Checks of a draft against its recipe (kind and number of candidates)."""
    questions = draft.get("questions")
    single = set(draft) == {"questions"} and isinstance(questions, dict) and len(questions) == 1
    yield "one_question_required_no_labels", not single
    wrong = request_error({"state": state, "questions": questions}, ("choice", "noul"))
    yield wrong or "", wrong is not None
    q = next(iter(questions.values()))
    asked = isinstance(q["instructions"], str) and q["instructions"].strip()
    yield "invalid_instructions_or_type", not asked or q["type"] != kind
    options = q.get("criteria") or {}
    if kind == "choice":
        yield "candidate_count_mismatch", len(options) != k
        for forms in ([folded_form(n) for n in options], [folded_form(v if isinstance(v, str) else canonical(v)) if v is not None else "" for v in options.values()]):
            yield "duplicate_or_empty_candidate", not all(forms) or len(set(forms)) < len(forms)
        yield "option_too_long", any(count(canonical(v)) > limits["option"] for v in options.values())
    held = count(canonical(state))
    yield "state_too_long", held > limits["state"]
    shared = held + count(canonical({x: q[x] for x in ("type", "instructions")})) + (count(canonical(options)) if kind == "choice" else 0)
    paths = [shared + count(canonical(v)) for v in (options.values() if kind == "choice" else (False, True))]
    yield "path_too_long", max(paths) > limits["path"]
    yield "request_too_long", sum(paths) > limits["total"]


def _texts_only(values: object) -> bool:
    return isinstance(values, list) and all(isinstance(v, str) and v.strip() for v in values)


def review_errors(review: dict, texts: list[str]) -> Iterator[tuple[str, bool]]:
    """Checks of a review of a state with these message texts."""
    yield "invalid_review_fields", set(review) != REVIEW_FIELDS
    checks = review["checks"]
    yield "invalid_review_checks", not isinstance(checks, dict) or set(checks) != set(CHECKS) or not all(isinstance(v, bool) for v in checks.values())
    yield "invalid_review_decision", review["decision"] not in ("accept", "reject")
    yield "invalid_review_evidence", not (_texts_only(review["issues"]) and _texts_only(review["evidence"]))
    quoted = [any(e in t for t in texts) for e in review["evidence"]]
    yield "review_evidence_not_in_state", not quoted or not all(quoted)
    fine = all(checks.values()) and not review["issues"]
    yield "inconsistent_review", (review["decision"] == "accept") != fine


def record_errors(row: dict) -> Iterator[tuple[str, bool]]:
    """Checks of a record: its fields, its request, and what is derived from it."""
    fixed = set(row) == RECORD_FIELDS and row["schema_version"] == SCHEMA and row["training_eligible"] is False
    yield "invalid_unlabeled_record", not fixed
    wrong = request_error(row["input"], ("choice", "noul")) if isinstance(row["input"], dict) else "invalid_unlabeled_record"
    yield wrong or "", wrong is not None
    origin = row["provenance"]
    yield "record_identity_or_split_mismatch", origin.get("split") != SPLIT or not origin.get("group_id") or row["input_sha256"] != digest(row["input"])
    named = "question_" + digest([origin.get("id"), row["input"]["questions"]])
    yield "record_id_or_status_mismatch", row["id"] != named or row["status"] != STATUS


def first(checks: Iterator[tuple[str, bool]]) -> str | None:
    return next((reason for reason, holds in checks if holds), None)


def _judged(check: Callable, *columns: pd.Series) -> pd.Series:
    def one(*values: object) -> str | None:
        try:
            return first(check(*values))
        except ValueError as e:
            return str(e)

    return pd.Series([one(*v) for v in zip(*columns, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def validate_drafts(drafts: pd.Series, states: pd.Series, kinds: pd.Series, ks: pd.Series) -> pd.Series:
    """Null for a valid draft's text, else a reason. states: JSON objects."""
    return _judged(lambda d, s, kind, k: draft_errors(parse_object(d or ""), parse_object(s or ""), kind, k), drafts, states, kinds, ks)


@F.pandas_udf(StringType())
def validate_reviews(reviews: pd.Series, texts: pd.Series) -> pd.Series:
    """Null for a consistent review's text, else a reason. texts: arrays of message texts."""
    return _judged(lambda r, t: review_errors(parse_object(r or ""), [x for x in t if x is not None] if t is not None else []), reviews, texts)


@F.pandas_udf(StringType())
def validate_records(records: pd.Series) -> pd.Series:
    """Null for a valid record's text, else a reason."""
    return _judged(lambda r: record_errors(parse_object(r or "")), records)
