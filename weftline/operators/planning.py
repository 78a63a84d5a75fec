"""Plans of question runs: recipes by quota, jobs, request ids, run fingerprints. Small tables, made on the driver."""

from __future__ import annotations

import hashlib
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.strict_json import canonical
from weftline.operators.selection import largest_remainder

# Sizes of choice questions by bucket with their weight, the share of choice questions in a hundred, how many
# have 255 candidates at least, and the other dimensions of a recipe.
BUCKETS = {"2-8": (2, 8, 45), "9-32": (9, 32, 25), "33-64": (33, 64, 15), "65-128": (65, 128, 10), "129-255": (129, 255, 5)}
CHOICE_PERCENT = 80
FULL_SIZE_MIN = 2
LANGUAGES = ("zh", "en", "ja")
FORMS = ("direct", "constraint", "scenario_action", "negative_or_exception", "history_dependent")
OPTION_STYLES = ("short", "phrase", "sentence", "structured")
RETRY_LIMIT = 3
#: Codes that a codebook may have.
MAX_CODES = 100_000


def _number(low: int, high: int, *key: object) -> int:
    """A number of a range that depends on the key alone."""
    digest = hashlib.sha256(canonical(list(key)).encode()).hexdigest()
    return low + int(digest[:12], 16) % (high - low + 1)


def recipes(slots: int, seed: int) -> list[dict]:
    """slot, type, bucket, k, language, form, option_style: exact quotas, buckets interleaved round-robin.

    The bucket of the largest questions leads, and its first FULL_SIZE_MIN have 255 candidates; so one is among the
    first six slots. What quotas don't fix is drawn from digests of the seed and the slot.
    """
    ends = sorted((low, high) for low, high, _ in BUCKETS.values())
    if ends[0][0] != 2 or ends[-1][1] != 255 or any(a[1] + 1 != b[0] for a, b in zip(ends, ends[1:], strict=False)):
        raise ValueError("buckets must tile 2 to 255")
    choices = largest_remainder(slots, {"choice": Fraction(CHOICE_PERCENT), "noul": Fraction(100 - CHOICE_PERCENT)})
    left = largest_remainder(choices["choice"], {b: Fraction(w) for b, (_, _, w) in BUCKETS.items()}) | {"noul": choices["noul"]}
    order = sorted(left, key=lambda b: -BUCKETS[b][1] if b in BUCKETS else 0)
    out: list[dict] = []
    full = 0
    while any(left.values()):
        for b in order:
            if not left[b]:
                continue
            left[b] -= 1
            slot = len(out)
            k = 2 if b == "noul" else _number(BUCKETS[b][0], BUCKETS[b][1], seed, slot, b)
            if b == order[0] and full < FULL_SIZE_MIN:
                k, full = 255, full + 1
            drawn = {n: v[_number(0, len(v) - 1, seed, slot, n)] for n, v in (("language", LANGUAGES), ("form", FORMS), ("option_style", OPTION_STYLES))}
            out.append({"slot": slot, "type": "noul" if b == "noul" else "choice", "bucket": b, "k": k, **drawn})
    return out


def jobs_of(spark: SparkSession, plan: list[dict], attempts: int = RETRY_LIMIT) -> DataFrame:
    """turn (from 0), slot, attempt, need (only a prefix with history will do): all slots of the first attempt, then of the next."""
    rows = [(r["slot"], r["form"] == "history_dependent") for r in plan]
    slots = spark.createDataFrame(rows or [(0, False)], "slot long, need boolean").limit(len(rows))
    place = F.row_number().over(Window.orderBy("slot")) - 1
    numbered = slots.withColumn("_p", place)
    each = numbered.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    return each.select((F.col("attempt") * len(rows) + F.col("_p")).alias("turn"), "slot", "attempt", "need")


def assign(jobs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """slot, attempt, id: jobs in turn, each with the first prefix left that suits it; jobs for which none is left get no row.

    jobs: jobs_of(); prefixes: id, history, position (from 0). Prefixes with history leave in order, and so do the others,
    whoever takes them. A prefix without history at position p is taken by the first job for any prefix whose turn is p or
    later, after the job that took such a prefix before it: a running maximum. The remaining jobs take the prefixes with
    history, by rank. Tables are bounded by the number of jobs, see eligible().
    """
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - 1
    numbered = jobs.withColumn("k", rank("need", "turn"))  # for any prefix: k jobs such before
    plain = prefixes.where("NOT history").withColumn("n", rank(F.lit(0), "position"))
    # f: how many jobs for any prefix come before the turn that equals the position
    earlier = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = jobs.select(F.col("turn").alias("position"), F.coalesce(F.count_if(~F.col("need")).over(earlier), F.lit(0)).alias("f"))
    ahead = plain.join(before, "position", "left").withColumn("f", F.coalesce("f", F.lit(jobs.where("NOT need").count())))
    latest = F.max(F.col("f") - F.col("n")).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    taken = ahead.select("id", (F.col("n") + latest).alias("k"))
    free = numbered.where("NOT need").join(taken, "k", "left").select("turn", "slot", "attempt", "id")
    left = free.where("id IS NULL").select("turn", "slot", "attempt").unionByName(numbered.where("need").select("turn", "slot", "attempt"))
    ranked = prefixes.where("history").select("id", rank(F.lit(0), "position").alias("y"))
    given = left.withColumn("y", rank(F.lit(0), "turn")).join(ranked, "y")
    return free.where("id IS NOT NULL").select("slot", "attempt", "id").unionByName(given.select("slot", "attempt", "id"))


def eligible(bounds: DataFrame, demand: int, order: str, history: Column) -> DataFrame:
    """id, history, position: all rows of bounds that assign() can take for `demand` jobs.

    A job takes the first row left of all, or of those with history; so none takes a row behind the first `demand` of both.
    """
    rows = bounds.select(F.col(order).alias("id"), F.coalesce(history, F.lit(False)).alias("history"))
    first = [r.orderBy("id").limit(demand) for r in (rows, rows.where("history"))]
    both = first[0].union(first[1]).distinct()
    return both.withColumn("position", F.row_number().over(Window.orderBy("id")) - 1)


def fingerprint(**parts: object) -> str:
    """Digest of what a run depends on; a run resumes only under the same one."""
    return hashlib.sha256(canonical(parts).encode()).hexdigest()


def resume_gate(stored: str | None, current: str) -> None:
    if stored is not None and stored != current:
        raise ValueError("the run was started with other settings")


def request_id(job: Column, role: Column, body: Column) -> Column:
    """Digest of the canonical request: equal requests share one id and so one cached answer."""
    return F.sha2(F.to_json(F.struct(body.alias("body"), job.alias("job"), role.alias("role"))), 256)


# Temperatures by role.
TEMPERATURES = {"generate": 0.7, "review": 0.0}


def request_body(role: Column, text: Column, suffixes: dict[str, str]) -> Column:
    """What is sent for a role: the canonical input, the role's suffix and temperature."""
    by_role = lambda values: F.coalesce(*[F.when(role == r, F.lit(v)) for r, v in values.items()])
    return F.struct(text.alias("input"), by_role(suffixes).alias("suffix"), by_role(TEMPERATURES).alias("temperature"))


def bucket_of(k: Column) -> Column:
    """The bucket of a choice by its number of candidates."""
    return F.coalesce(*[F.when(k.between(low, high), F.lit(name)) for name, (low, high, _) in BUCKETS.items()])


def codebook_audit(pool: DataFrame, book: DataFrame, encode, prefixes: tuple[str, ...], numbers: range) -> DataFrame:
    """pool, selected, distinct_tokens, prefixes, numbers, number_tokens: the sizes of a codebook and of plain numbers instead."""
    tokens = book.join(pool, "code").agg(F.count("*").cast("int").alias("selected"), F.countDistinct("token_id").cast("int").alias("distinct_tokens"))
    plain = pool.sparkSession.range(numbers.start, numbers.stop).select(F.size(encode(F.lpad(F.col("id").cast("string"), 2, "0"))).alias("n"))
    sizes = plain.agg(F.count("*").cast("int").alias("numbers"), F.sum("n").alias("number_tokens"))
    # three tables of one row
    return pool.agg(F.count("*").cast("int").alias("pool")).crossJoin(tokens).crossJoin(sizes).select("pool", "selected", "distinct_tokens", F.lit(len(prefixes)).alias("prefixes"), "numbers", "number_tokens")


def letter_codes(spark: SparkSession) -> DataFrame:
    """code: the 676 pairs of capital letters."""
    i = F.col("id")
    letter = lambda n: F.char(n + 65)
    return spark.range(676).select(F.concat(letter(F.floor(i / 26)), letter(i % 26)).alias("code"))


def single_token(codes: DataFrame, encode, prefixes: tuple[str, ...]) -> DataFrame:
    """Codes that are one token after every prefix, the same one, and give another code no claim to it.

    encode: a column function of text giving an array of token ids (a vectorised UDF over a tokenizer).
    """
    n = len(prefixes)
    tails = F.array(*[F.slice(encode(F.concat(F.lit(p), "code")), F.size(encode(F.lit(p))) + 1, F.lit(8)) for p in prefixes])
    found = codes.withColumn("tails", tails).where(F.forall("tails", lambda t: F.size(t) == 1))
    found = found.withColumn("token_id", F.get(F.get("tails", F.lit(0)), F.lit(0)))
    same = found.where(F.size(F.filter("tails", lambda t: F.get(t, F.lit(0)) == F.col("token_id"))) == n)
    once = same.groupBy("token_id").agg(F.min("code").alias("code"), F.count("*").alias("_n")).where("_n = 1")
    return once.select("code", "token_id")


def codebook(codes: DataFrame, size: int, seed: int) -> DataFrame:
    """position, code: a sample without replacement in digest order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), "code"), 256)
    picked = codes.withColumn("_d", digest).orderBy("_d", "code").limit(size)
    all_ = F.array_sort(F.collect_list(F.struct("_d", "code")))
    return picked.agg(all_.alias("a")).select(F.posexplode("a").alias("position", "r")).select("position", "r.code")


def tasks(candidates: DataFrame, codes: DataFrame, repeat: bool = False) -> DataFrame:
    """question, candidate, code: names in code point order, each with the code of its place in the question's own sample.

    candidates: question, candidate. The place is the name's rank; the codebook's order is turned by the question's seed.
    A question with more candidates than there are codes is an error when the result is read; or, with repeat, its codes
    come round again.
    """
    size = codes.count()
    if size > MAX_CODES:
        raise ValueError("a codebook is broadcast; it can't have so many codes")
    place = F.row_number().over(Window.partitionBy("question").orderBy("candidate")) - 1
    ranked = candidates.where("candidate IS NOT NULL").select("question", "candidate").distinct().withColumn("place", place)
    turned = F.pmod(F.conv(F.substring(F.sha2(F.col("question").cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(size))
    fits = F.lit(True) if repeat else F.assert_true(F.col("place") < size, "more candidates than codes").isNull()
    each = ranked.where(fits).select("question", turned.alias("turn"), "place", "candidate")
    at = each.withColumn("position", F.pmod(F.col("turn") + F.col("place"), F.lit(size)).cast("int"))
    return at.join(F.broadcast(codes), "position").select("question", "candidate", "code")
