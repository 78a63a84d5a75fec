"""Public requests as JSON text: strict validation with a reason, in an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.functions.strict_json import finite, parse_object

# Kinds of questions with their fields, and limits.
FIELDS = {"choice": {"type", "instructions", "criteria"}, "score": {"type", "instructions", "criteria"}, "noul": {"type", "instructions"}}
MAX_QUESTIONS = 64
CHOICE_SIZE = range(2, 256)
SCORE_SIZE = range(2, 11)


def _described(value: object) -> bool:
    """A text, object or list that isn't empty, and finite all through."""
    return isinstance(value, (str, dict, list)) and bool(value) and finite(value)


def question_error(q: object, kinds: tuple[str, ...] = tuple(FIELDS)) -> str | None:
    if not isinstance(q, dict):
        return "invalid_question"
    kind = q.get("type")
    if not isinstance(kind, str) or kind not in kinds:
        return "unsupported_type"
    if set(q) != FIELDS[kind]:
        return "invalid_question_fields"
    if not _described(q["instructions"]):
        return "invalid_instructions"
    criteria = q.get("criteria")
    if kind == "choice":
        if not isinstance(criteria, dict) or len(criteria) not in CHOICE_SIZE:
            return "choice_size"
        if not all(name.strip() for name in criteria):
            return "invalid_candidate_name"
        if not all(v is None or _described(v) for v in criteria.values()):
            return "invalid_description"
    if kind == "score":
        if not isinstance(criteria, list) or len(criteria) not in SCORE_SIZE:
            return "score_size"
        if not all(map(_described, criteria)):
            return "invalid_description"
    return None


def request_error(request: dict, kinds: tuple[str, ...] = tuple(FIELDS)) -> str | None:
    """Null for a valid request, else the first thing that is wrong with it."""
    if set(request) - {"model", "state", "questions"}:
        return "unknown_fields"
    if not {"state", "questions"} <= set(request):
        return "missing_fields"
    if not isinstance(request["state"], (str, dict, list)) or not finite(request["state"]):
        return "invalid_state"
    if "model" in request and not (isinstance(request["model"], str) and request["model"]):
        return "invalid_model"
    questions = request["questions"]
    if not isinstance(questions, dict) or not 1 <= len(questions) <= MAX_QUESTIONS:
        return "question_count"
    if not all(questions):
        return "invalid_question_name"
    return next((e for q in questions.values() if (e := question_error(q, kinds))), None)


@F.pandas_udf(StringType())
def validate_requests(texts: pd.Series) -> pd.Series:
    """Null for a valid request's text, else a reason."""

    def check(text: str | None) -> str | None:
        try:
            return request_error(parse_object(text or ""))
        except ValueError as e:
            return str(e)

    return texts.map(check).astype(object)
