"""Evaluation of probabilistic decisions: losses, calibration, selective risk, temperature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def losses(rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """One row: n, nll, brier and accuracy of binary outcomes y with probability p."""
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    nll = -F.when(F.col(y) == 1, F.log(clipped)).otherwise(F.log(1 - clipped))
    hit = ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")
    return rows.agg(F.count("*").alias("n"), F.avg(nll).alias("nll"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(hit).alias("accuracy"))


def reliability(rows: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """bin, n, mean_p, mean_y by equal-width bins of p."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    table = reliability(rows, bins)
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def coverage_curve(rows: DataFrame, steps: int = 100, confidence: str = "confidence", error: str = "error") -> DataFrame:
    """step, coverage, risk: the error rate of the decisions that are at least as confident, at `steps` thresholds.

    Confidences are binned first, so the cumulative window runs over bins, not rows.
    """
    bin_ = F.least(F.floor(F.col(confidence) * steps), F.lit(steps - 1))
    binned = rows.groupBy(bin_.alias("step")).agg(F.count("*").alias("n"), F.sum(error).alias("e"))
    w = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return binned.select(
        "step", (F.sum("n").over(w) / F.sum("n").over(whole)).alias("coverage"), (F.sum("e").over(w) / F.sum("n").over(w)).alias("risk")
    )


def entropy_concentration(p: Column) -> Column:
    """1 - H / ln K; 1 for a single candidate."""
    h = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return F.when(F.size(p) <= 1, 1.0).otherwise(1 - h / F.log(F.size(p).cast("double")))


def score_variance(p: Column) -> Column:
    level = F.sequence(F.lit(0), F.size(p) - 1)
    total = lambda f: F.aggregate(F.zip_with(p, level, f), F.lit(0.0), lambda s, x: s + x)
    return total(lambda x, i: x * i * i) - F.pow(total(lambda x, i: x * i), F.lit(2))


def tail_mass(p: Column, bound: int) -> Column:
    """Probability of levels from bound on."""
    return F.aggregate(F.slice(p, F.lit(bound + 1), F.greatest(F.size(p) - bound, F.lit(0))), F.lit(0.0), lambda s, x: s + x)


def soft_cross_entropy(rows: DataFrame) -> DataFrame:
    """question, loss of a long table (question, candidate, q, p): the target q against the prediction p."""
    return rows.groupBy("question").agg(F.sum(-F.col("q") * F.log(F.greatest("p", F.lit(1e-12)))).alias("loss"))


def temperature_fit(rows: DataFrame, grid: list[float], z: str = "z", y: str = "y") -> DataFrame:
    """One row: the temperature of the grid with the least NLL of binary logits z, and that NLL."""
    each = rows.select(F.explode(F.array(*map(F.lit, grid))).alias("t"), z, y)
    signed = F.when(F.col(y) == 1, F.col(z)).otherwise(-F.col(z)) / F.col("t")
    nll = F.greatest(-signed, F.lit(0.0)) + F.log(1 + F.exp(-F.abs(signed)))
    fits = each.groupBy("t").agg(F.round(F.avg(nll), 9).alias("nll"))
    return fits.agg(F.min(F.struct("nll", "t")).alias("b")).select(F.col("b.t").alias("t"), F.col("b.nll").alias("nll"))


def workflow(rows: DataFrame, threshold: float, p: str = "p", y: str = "y", latency: str = "latency") -> DataFrame:
    """One row: automation coverage, error rate of what is automated, review rate, median and 95th percentile latency."""
    sure = F.greatest(F.col(p), 1 - F.col(p)) >= threshold
    wrong = sure & ((F.col(p) >= 0.5).cast("int") != F.col(y))
    return rows.agg(
        F.avg(sure.cast("double")).alias("coverage"),
        (F.count_if(wrong) / F.greatest(F.count_if(sure), F.lit(1))).alias("error_rate"),
        F.avg((~sure).cast("double")).alias("review_rate"),
        F.percentile(latency, 0.5).alias("p50"),
        F.percentile(latency, 0.95).alias("p95"),
    )


def classwise_calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """class, n, ece of a table (class, p: its probability, y: whether it was right)."""
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    binned = rows.groupBy("class", bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))
    gap = F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")
    return binned.groupBy("class").agg(F.sum("n").alias("n"), gap.alias("ece"))
