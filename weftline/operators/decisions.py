"""Typed decisions: candidates in order, logits to probabilities, answers by kind, traces and variants."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T

KINDS = ("choice", "noul", "score")
TEMPERATURES = (1, 2, 4)


def candidate_order(kind: str, criteria: Column | None = None, levels: Column | None = None) -> Column:
    """Ids in canonical order: names by code point; level numbers as text; false, true."""
    if kind == "choice":
        return F.array_sort(F.map_keys(criteria))
    if kind == "score":
        return F.transform(F.sequence(F.lit(0), F.size(levels) - 1), lambda i: i.cast("string"))
    return F.array(F.lit("false"), F.lit("true"))


def logsumexp(z: Column) -> Column:
    top = F.array_max(z)
    return top + F.log(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(z))))


def softmax(z: Column, temperature: float = 1.0) -> Column:
    """Probabilities of logits at a temperature; null where the list is empty or a logit isn't finite."""
    if not temperature > 0 or not math.isfinite(temperature):
        raise ValueError("a temperature is a positive, finite number")
    t = F.lit(float(temperature))
    ok = (F.size(z) > 0) & F.forall(z, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp((x - F.array_max(z)) / t))
    return F.when(ok, F.transform(z, lambda x: F.exp((x - F.array_max(z)) / t) / whole))


def choice(p: Column, ids: Column) -> Column:
    """The most probable candidate (the first of equal ones), its probability and its lead over the next."""
    sorted_ = F.sort_array(p, asc=False)
    return F.struct(
        F.element_at(ids, F.array_position(p, F.array_max(p)).cast("int")).alias("choice"),
        F.array_max(p).alias("probability"),
        (F.get(sorted_, F.lit(0)) - F.coalesce(F.get(sorted_, F.lit(1)), F.lit(0.0))).alias("margin"),
    )


def score(p: Column) -> Column:
    """The expected level."""
    return F.aggregate(F.zip_with(p, F.sequence(F.lit(0), F.size(p) - 1), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)


def noul(p: Column) -> Column:
    return F.element_at(p, 2)


def legal_mass(candidates: Column, vocabulary: Column) -> Column:
    """The share of probability that falls on the candidates."""
    return F.exp(logsumexp(candidates) - logsumexp(vocabulary))


def variants(traces: DataFrame, temperatures: tuple[int, ...] = TEMPERATURES, counts: tuple[int, ...] = (1, 4)) -> DataFrame:
    """question, m, t, candidate, p: each trace tempered, then the first m traces averaged, by candidate name.

    traces: question, trace (from 0), candidate, logit, in long form; the grid is a handful of constants.
    """
    w = F.array(*[F.struct(F.lit(t).alias("t")) for t in temperatures])
    grid = traces.withColumn("g", F.explode(w)).withColumn("t", F.col("g.t")).drop("g")
    top = grid.groupBy("question", "trace", "t").agg(F.max("logit").alias("top"))
    e = grid.join(top, ["question", "trace", "t"]).withColumn("e", F.exp((F.col("logit") - F.col("top")) / F.col("t")))
    whole = e.groupBy("question", "trace", "t").agg(F.sum("e").alias("whole"))
    p = e.join(whole, ["question", "trace", "t"]).withColumn("p", F.col("e") / F.col("whole"))
    chosen = p.withColumn("m", F.explode(F.array(*[F.lit(m) for m in counts]))).where("trace < m")
    return chosen.groupBy("question", "m", "t", "candidate").agg(F.avg("p").alias("p"))


def target_errors(target: Column, candidates: Column) -> Column:
    """Null for a valid distribution (map of name to probability) over the candidates; else the reason."""
    values = F.map_values(target)
    whole = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < F.lit(float("inf"))))
    return (
        F.when(F.array_sort(F.map_keys(target)) != F.array_sort(candidates), "candidate_coverage")
        .when(~fine, "invalid_probability")
        .when(F.abs(whole - 1) > 1e-6, "unnormalized")
    )


def same_distribution(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    """Equal names, and probabilities close to each other, relatively or absolutely."""
    close = lambda k: F.abs(a[k] - b[k]) <= F.greatest(F.greatest(F.abs(a[k]), F.abs(b[k])) * tolerance, F.lit(tolerance))
    keys = F.array_sort(F.map_keys(a))
    return F.when(keys != F.array_sort(F.map_keys(b)), False).otherwise(F.forall(keys, close))


def request_errors(kind: Column, instructions: Column, n_criteria: Column, blank: Column) -> Column:
    """Null for a valid question; else what is wrong with it. blank: some description is empty."""
    return (
        F.when(~kind.isin(*KINDS), "unknown_type")
        .when(F.coalesce(F.trim(instructions), F.lit("")) == "", "missing_instructions")
        .when((kind == "choice") & ~n_criteria.between(2, 255), "choice_size")
        .when((kind == "score") & ~n_criteria.between(2, 10), "score_size")
        .when((kind == "noul") & (n_criteria > 0), "noul_has_criteria")
        .when(blank, "empty_description")
    )


def paths(state: Column, kind: Column, instructions: Column, criteria: Column, candidates: Column) -> Column:
    """One text for each candidate: the shared state and question, then the candidate's part; `<` can't open a control token.

    criteria is canonical JSON of all candidates and is part of the question for a choice only.
    """
    safe = lambda c: F.replace(c, F.lit("<"), F.lit("\\u003c"))
    question = F.to_json(F.struct(instructions.alias("instructions"), kind.alias("type")))
    shared = F.concat(F.lit("STATE "), safe(state), F.lit("QUESTION "), safe(question), F.when(kind == "choice", safe(criteria)).otherwise(""))
    return F.transform(candidates, lambda c: F.concat(shared, F.lit("CANDIDATE "), safe(c), F.lit("DECISION")))


def reversed_order(criteria: Column) -> Column:
    """Entries of a map in reverse canonical order, with their names listed: what a second reader is shown."""
    entries = F.array_sort(F.map_entries(criteria))
    return F.struct(F.reverse(entries).alias("entries"), F.reverse(F.transform(entries, lambda e: e["key"])).alias("order"))


def predict(requests: DataFrame, scorer, temperature: float = 1.0) -> DataFrame:
    """question, kind, choice, score, p_true of a table (question, kind, state, instructions, criteria, candidates).

    scorer: a column function of an array of path texts giving an array of logits (a vectorised UDF over a model).
    """
    text = paths(F.col("state"), F.col("kind"), F.col("instructions"), F.col("criteria"), F.col("candidates"))
    p = requests.withColumn("p", softmax(scorer(text), temperature))
    return p.select(
        "question",
        "kind",
        F.when(F.col("kind") == "choice", choice(F.col("p"), F.col("candidates"))).alias("choice"),
        F.when(F.col("kind") == "score", score(F.col("p"))).alias("score"),
        F.when(F.col("kind") == "noul", noul(F.col("p"))).alias("p_true"),
    )


def soft_replay(stored: DataFrame, questions: DataFrame, traces: DataFrame, n_traces: int) -> DataFrame:
    """question, outcome of soft records (question, target: map of candidate to probability).

    Each record is joined with its question and its traces' logits; its target is recomputed and compared. same,
    unknown_question, missing_traces or soft_target_replay_mismatch.
    """
    target = variants(traces, (1,), (n_traces,)).select("question", F.struct(F.col("candidate").cast("string").alias("key"), F.col("p").alias("value")).alias("e"))
    again = target.groupBy("question").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("again"))
    have = traces.groupBy("question").agg(F.countDistinct("trace").alias("n"))
    joined = stored.join(questions.select("question", F.lit(True).alias("known")), "question", "left").join(have, "question", "left").join(again, "question", "left")
    outcome = (
        F.when(F.col("known").isNull(), "unknown_question")
        .when(F.coalesce("n", F.lit(0)) < n_traces, "missing_traces")
        .when(~same_distribution(F.col("target"), F.col("again"), 1e-11), "soft_target_replay_mismatch")
        .otherwise("same")
    )
    return joined.select("question", outcome.alias("outcome"))


#: Legal mass may pass 1 by rounding.
MASS_LIMIT = 1.000001


def trace_error() -> Column:
    """Null for a trace that belongs to its question, else what doesn't agree.

    Columns: base, trace (seeds follow from both), seed, input_sha256, question_sha256, mass, scored, candidates, mode,
    verified (its answer's prefix was read back).
    """
    return (
        F.when(F.col("seed") != T.trace_seed(F.col("base"), F.col("trace")), "seed")
        .when(F.col("input_sha256") != F.col("question_sha256"), "input")
        .when(~F.col("mass").between(0, MASS_LIMIT) | F.isnan("mass"), "mass")
        .when(F.array_sort("scored") != F.array_sort("candidates"), "candidates")
        .when((F.col("mode") != "raw_logits"), "mode")
        .when(~F.col("verified"), "prefix")
    )
