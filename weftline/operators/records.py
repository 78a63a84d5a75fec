"""Question records: drafts, reviews, results, resuming and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.questions import CHECKS
from weftline.functions.strict_json import parse_strict

# The reasons of rejection that are reported by name.
REASONS = (
    "one_question_required_no_labels",
    "invalid_instructions_or_type",
    "candidate_count_mismatch",
    "duplicate_or_empty_candidate",
    "option_too_long",
    "state_too_long",
    "review_evidence_not_in_state",
    "inconsistent_review",
    "invalid_review_fields",
    "invalid_review_checks",
    "invalid_review_decision",
    "invalid_review_evidence",
    "invalid_json",
    "json_object_required",
    "duplicate_json_key",
    "nonfinite_json",
    "invalid_json_fence",
    "incomplete_response",
    "teacher_model_mismatch",
    "transport_attempts_exhausted",
    "http_error",
    "service_halted",
    "invalid_response",
)
OTHER_REASON = "format_or_budget_validation"
# The same for the collection of traces.
TRACE_REASONS = (
    "teacher_context_budget",
    "thinking_incomplete",
    "empty_thinking",
    "answer_prefix_roundtrip_failed",
    "actual_prefix_code_mismatch",
    "missing_answer_scores",
    "incomplete_vocabulary_scores",
    "nonfinite_vocabulary_scores",
)
OTHER_TRACE_REASON = "collection_validation_failed"
RETRYABLE = (408, 429)


def grounded(evidence: Column, texts: Column) -> Column:
    """Every quote occurs within some single text."""
    return F.forall(evidence, lambda e: F.exists(texts, lambda t: F.contains(t, e)))


def review_errors(decision: Column, checks: Column, issues: Column, evidence: Column, texts: Column) -> Column:
    """Null for a consistent review; checks is a map of check to boolean."""
    all_true = F.forall(F.map_values(checks), lambda v: v)
    blank = lambda xs: F.exists(xs, lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
    return (
        F.when(F.array_sort(F.map_keys(checks)) != F.array(*map(F.lit, sorted(CHECKS))), "invalid_review_checks")
        .when(~decision.isin("accept", "reject"), "invalid_review_decision")
        .when(blank(issues) | blank(evidence), "invalid_review_evidence")
        .when((F.size(evidence) == 0) | ~grounded(evidence, texts), "review_evidence_not_in_state")
        .when((decision == "accept") != (all_true & (F.size(issues) == 0)), "inconsistent_review")
    )


def public_reason(reason: Column, known: tuple[str, ...] = REASONS, other: str = OTHER_REASON) -> Column:
    return F.when(reason.isNull() | reason.isin(*known), reason).otherwise(other)


def status_class(status: Column) -> Column:
    return (
        F.when(status.between(200, 299), "ok").when(status.isin(*RETRYABLE) | status.between(500, 599), "retry").otherwise("halt")
    )


def pending(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs without a result (of any kind) whose slot has no accepted one."""
    done = jobs.join(results.select("job"), "job", "left_anti")
    return done.join(results.where("accepted").select("slot"), "slot", "left_anti")


def first_ok(attempts: DataFrame) -> DataFrame:
    """The first successful attempt of each request."""
    w = Window.partitionBy("request").orderBy("attempt")
    return attempts.where(status_class(F.col("status")) == "ok").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def accepted_export(results: DataFrame) -> DataFrame:
    """Accepted records by slot; a slot with two is an error when the result is read."""
    kept = results.where("accepted")
    n = F.count("*").over(Window.partitionBy("slot"))
    once = F.assert_true(n == 1, "a slot has two accepted records").isNull()
    return kept.withColumn("_once", once).where("_once").drop("_once")


def differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with side; empty where a replay agrees."""
    columns = sorted(stored.columns)
    a, b = stored.select(columns), recomputed.select(columns)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("recomputed")))


def replayed(attempts: DataFrame, limit: int) -> DataFrame:
    """request, attempts, outcome, body of logged attempts (request, attempt from 1, status, body), as a client makes them.

    Attempts go on until one is answered or refused, up to the limit; what the log holds beyond that is never looked at.
    """
    state = status_class(F.col("status"))
    made = attempts.where(F.col("attempt") <= limit).select("request", "attempt", state.alias("class"), "body")
    last = made.groupBy("request").agg(
        F.min(F.when(F.col("class") != "retry", F.struct("attempt", "class", "body"))).alias("end"), F.count("*").alias("made")
    )
    outcome = F.when(F.col("end.class") == "ok", "ok").when(F.col("end.class") == "halt", "http_error").otherwise("transport_attempts_exhausted")
    body = F.when(F.col("end.class") == "ok", F.col("end.body"))
    return last.select("request", F.coalesce(F.col("end.attempt").cast("long"), "made").alias("attempts"), outcome.alias("outcome"), body.alias("body"))


def run_replay(results: DataFrame, attempts: DataFrame) -> DataFrame:
    """request, outcome of stored results (request, record digest): each answer is read from its first good attempt again.

    same, record_replay_mismatch, no_answer, or the reason for which the answer can't be read.
    """
    answers = first_ok(attempts).select("request", "body")
    joined = results.join(answers, "request", "left").withColumn("r", parse_strict("body"))
    outcome = (
        F.when(F.col("body").isNull(), "no_answer")
        .when(F.col("r.reason").isNotNull(), F.col("r.reason"))
        .when(T.digest(F.col("r.json")) != F.col("record"), "record_replay_mismatch")
        .otherwise("same")
    )
    return joined.select("request", outcome.alias("outcome"))


def scan_counters(rows: DataFrame, by: str) -> DataFrame:
    """by, records, invalid_records, valid_records, no_prefix, over_budget, credential_excluded, eligible.

    rows: reason (null for valid records), fits, over, flagged; a valid record counts under the first rule that stops it.
    """
    ok = F.col("reason").isNull()
    stop = F.when(~F.col("fits"), "no_prefix").when(F.col("over"), "over_budget").when(F.col("flagged"), "credential_excluded").otherwise("eligible")
    marked = rows.select(by, ok.alias("ok"), F.when(ok, stop).alias("stop"))
    stops = [F.count_if(F.col("stop") == s).alias(s) for s in ("no_prefix", "over_budget", "credential_excluded", "eligible")]
    return marked.groupBy(by).agg(F.count("*").alias("records"), F.count_if(~F.col("ok")).alias("invalid_records"), F.count_if("ok").alias("valid_records"), *stops)


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """by, value, n: counts of the values of each column, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.by", "p.value").agg(F.count("*").alias("n"))


def summary(totals: DataFrame, **tables: DataFrame) -> DataFrame:
    """totals (one row) plus the number of rows of each table, and the marks that no build sets by itself."""
    for name, rows in tables.items():
        totals = totals.crossJoin(rows.agg(F.count("*").alias(name)))  # one row each
    return totals.withColumn("soft_labels", F.lit(0)).withColumn("training_approved", F.lit(False))


def usage(paths: Column, answers: Column, count) -> Column:
    """input_tokens, longest, output_tokens of a request; count: tokens of a text."""
    sizes = F.transform(paths, lambda p: count(p).cast("long"))
    whole = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.struct(whole(sizes).alias("input_tokens"), F.array_max(sizes).alias("longest"), whole(F.transform(answers, lambda a: count(a).cast("long"))).alias("output_tokens"))


def pool_records(rows: DataFrame, provenance: Column, *fields: str) -> DataFrame:
    """rows plus provenance (a structure) and id: `pool_` and the digest of both, in canonical order."""
    shaped = rows.withColumn("provenance", provenance)
    return shaped.withColumn("id", F.concat(F.lit("pool_"), T.digest(F.to_json(F.struct(*sorted([*fields, "provenance"]))))))


def make_record(rows: DataFrame, *fields: str) -> DataFrame:
    """rows plus id: `question_` and the digest of the canonical fields (in name order)."""
    body = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    return rows.withColumn("id", F.concat(F.lit("question_"), T.digest(body)))


def record_errors(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows whose id isn't the digest of their fields."""
    return make_record(rows.withColumn("_id", F.col("id")), *fields).where("id <> _id").drop("_id")
