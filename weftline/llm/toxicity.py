"""Toxic spans by a linear-chain conditional random field; documents are scored from its marginals.

Training, on a bounded sample of labelled documents (SAMPLE_ROWS, the first by a hash of their ids):
  1. Tokens get labels from the documents' labels: a token of a toxic document is offending where its word, or a
     beginning of it (inflected and disguised forms share one), is significantly more frequent in toxic documents.
     Features are 64-bit hashes; tasks count in how many documents of each label they occur, and only those that
     become features of the chain (MAX_FEATURES at most) reach the driver.
  2. A two-state chain learns emission weights of the features (word and beginnings) of a token and its neighbours, and
     transition weights, by gradient ascent on the conditional likelihood, with forward-backward expectations. It is
     trained on CHAIN_DOCS documents of the sample, whole ones, in order of their hashes, half of them toxic, of
     CHAIN_CHARS characters together at most; the driver holds their words' numbers, not the words.
  3. A logistic calibration on the sample's own labels turns sums of marginals into a score; tasks compute the sums.
Scoring, over all documents: forward-backward marginals of every token; the document's score; offending offsets.

Inputs of a score are the text alone. Words are read without case and punctuation. Forward-backward runs over all
documents of an Arrow batch at once, step by step, in odds form, which can't overflow.

Defined results: null text counts as empty; an empty text gets the calibrated score of no evidence; repeated rows and
equal texts score alike; very long texts are scored whole, in memory proportional to the longest one of a batch; without
labelled rows, or with one class only, the score is the share of toxic labels (0.0 without any); an empty table gives an
empty result. Labels: null labels and null ids are left out; repeated labels of an id count as toxic if any is, and of
repeated rows of an id the least text is learnt from. Only the id and the text are read, so further columns of any name
don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.sampling import first_by_hash
from weftline.plans.staging import staged

#: Labelled documents to learn from, at most.
SAMPLE_ROWS = 6000
#: Documents of that sample whose chains are trained on, at most: toxic ones and as many others; and their characters.
CHAIN_DOCS = 1000
CHAIN_CHARS = 6_000_000
#: The chain is trained on runs of this many tokens (scores come from whole texts).
SEGMENT = 512
#: A feature of the chain is significant, or stands in so many documents of the sample; the most frequent ones come first.
LEAST_DOCS = 25
MAX_FEATURES = 100_000
#: Features that a counting task holds before it passes them on.
HELD_FEATURES = 400_000
#: Documents of one step of forward-backward; their tokens are held together.
STEP_CHARS = 2_000_000
#: Lengths of the beginnings that are features.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Words whose weights a task remembers from batch to batch.
HELD_WORDS = 300_000
#: A feature's excess in toxic documents must be this many standard errors, to label tokens.
Z = 4.0
#: A token is reported as offending from this marginal.
SPAN_MARGINAL = 0.5
_TOKEN = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column, remainder: int) -> Column:
    """crc32 of the id as text, modulo 5, equals remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == remainder, F.lit(False))


def tokens(text: str | None) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text or "")]


def features_of(word: str) -> list[int]:
    """Signed 64-bit hashes of the word and of its beginnings (marked, so that no word equals one)."""
    names = [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]
    return [h - (1 << 64) if (h := xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass"))) >> 63 else h for n in names]


class Lexicon(dict):
    """Number of each word met, in order; links has (word's number, feature's place) of the chain's features."""

    def __init__(self, features: dict[int, int]):
        super().__init__()
        self.features = features
        self.links: list[tuple[int, int]] = []
        self.known = np.zeros((3, 0))

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.links += [(n, i) for f in features_of(word) if (i := self.features.get(f)) is not None]
        return n

    def taken(self) -> np.ndarray:
        """The links found since the last call."""
        at = np.array(self.links, np.int64).reshape(-1, 2)
        self.links = []
        return at

    def weights(self, theta: np.ndarray) -> np.ndarray:
        """The words' three summed weights (as the token before, the token, the token after); always of the same theta."""
        n, at = self.known.shape[1], self.taken()
        if n < len(self):
            new = [np.bincount(at[:, 0] - n, t[at[:, 1]], len(self) - n) for t in theta]
            self.known = np.concatenate((self.known, new), 1)
        return self.known


@dataclass
class Chain:
    """features: places of the features that have weights; theta: their weights for the offending state, 3 x features."""

    features: dict[int, int]
    theta: np.ndarray
    bias: float = 0.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(5))
    lexicon: Lexicon | None = None

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """documents() of texts; the lexicon starts anew when it has grown too large."""
        if self.lexicon is None or len(self.lexicon) > HELD_WORDS // 2:
            self.lexicon = Lexicon(self.features)
        known = self.lexicon
        ids = [np.fromiter(map(known.__getitem__, ws := tokens(t)), np.int64, len(ws)) for t in texts]
        return self.documents(ids, known.weights(self.theta))

    def emissions(self, ids: np.ndarray, weights: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        e = self.bias + weights[1][ids]
        before, after = weights[0][ids], weights[2][ids]
        first = np.zeros(len(ids), bool)
        first[starts[lengths > 0]] = True
        e[1:] += np.where(first[1:], 0.0, before[:-1])
        e[:-1] += np.where(first[1:], 0.0, after[1:])
        return np.clip(e, -30, 30)

    def marginals(self, e: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Odds of the offending state at each token, given the text; and the forward and backward odds."""
        a, x = np.exp(np.clip(self.transitions, -10, 10)), np.exp(e)
        r, s = np.ones(len(e)), np.ones(len(e))
        order = np.argsort(-lengths, kind="stable")
        begin, size = starts[order], lengths[order]
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), side="left")  # documents longer than t
        for t in range(longest):
            at = begin[: active[t]] + t
            if t:
                p = r[at - 1]
                r[at] = x[at] * (a[0, 1] + p * a[1, 1]) / (a[0, 0] + p * a[1, 0])
            else:
                r[at] = x[at]
        for t in range(longest - 2, -1, -1):
            at = begin[: active[t + 1]] + t
            q = x[at + 1] * s[at + 1]
            s[at] = (a[1, 0] + a[1, 1] * q) / (a[0, 0] + a[0, 1] * q)
        return r * s, r, s

    def documents(self, ids: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch: marginal probabilities of all tokens, starts, and the documents' features."""
        lengths = np.array([len(x) for x in ids], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
        odds = self.marginals(self.emissions(flat, weights, starts, lengths), starts, lengths)[0]
        p = odds / (1 + odds)

        def total(x: np.ndarray) -> np.ndarray:
            cum = np.concatenate(([0.0], np.cumsum(x)))
            return cum[starts + lengths] - cum[starts]

        top = np.zeros(len(ids))
        full = lengths > 0
        if full.any():
            top[full] = np.maximum.reduceat(p, starts[full])
        rate = total(p) / np.maximum(lengths, 1) * 100
        columns = [np.ones(len(ids)), np.log1p(total(p)), top, np.log1p(rate), np.log1p(total(p >= SPAN_MARGINAL))]
        return p, starts, np.column_stack(columns)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.calibration, -30, 30)))


def significant(yes: np.ndarray, no: np.ndarray, n_yes: int, n_no: int) -> np.ndarray:
    """Features significantly more frequent in toxic documents (log odds over its standard error beyond Z)."""
    a, b, c, d = yes + 0.5, no + 0.5, n_yes - yes + 0.5, n_no - no + 0.5
    return (yes >= 3) & (np.log(a * d / (b * c)) > Z * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d))


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, yes, no: in how many toxic and in how many other documents of rows (text, toxic) each feature stands."""

    def counted(held: Counter) -> pa.RecordBatch:
        keys = pa.array([f for f, _ in held], pa.int64())
        toxic = np.array([y for _, y in held], np.int64)
        n = np.fromiter(held.values(), np.int64, len(held))
        return pa.RecordBatch.from_arrays([keys, pa.array(n * toxic), pa.array(n * (1 - toxic))], ["feature", "yes", "no"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.update((f, y) for f in {f for w in set(tokens(text)) for f in features_of(w)})
                if len(held) > HELD_FEATURES:
                    yield counted(held)
                    held = Counter()
        if held:
            yield counted(held)

    found = rows.select("text", "toxic").mapInArrow(run, "feature bigint, yes bigint, no bigint")
    return found.groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def train(rows: DataFrame, steps: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Chain:
    """The chain learnt from sample()'s rows."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_yes, n_no = sizes.get(1, 0), sizes.get(0, 0)
    if not n_yes or not n_no:
        chain = Chain({}, np.zeros((3, 0)), bias=-30.0)
        chain.calibration[0] = 30.0 if n_yes else -30.0
        return chain
    counts = feature_counts(rows)
    # what can't be significant with its yes of n_yes stays on the executors
    kept = counts.where(f"yes >= 3 AND yes * {n_no} > no * {n_yes} OR yes + no >= {LEAST_DOCS}")
    kept = kept.orderBy(F.desc(F.col("yes") + F.col("no")), "feature").limit(MAX_FEATURES).toArrow()
    names, yes, no = (kept.column(c).to_numpy() for c in ("feature", "yes", "no"))
    bad = significant(yes, no, n_yes, n_no)
    used = bad | (yes + no >= LEAST_DOCS)
    features = {f: i for i, f in enumerate(names[used].tolist())}
    suspects = set(np.flatnonzero(bad[used]).tolist())
    known, ids, toxic = Lexicon(features), [], []
    for r in _chain_rows(rows).toLocalIterator():
        ws = tokens(r["text"])
        whole = np.fromiter(map(known.__getitem__, ws), np.int32, len(ws))
        runs = [whole[i : i + SEGMENT] for i in range(0, len(whole), SEGMENT)]
        ids += runs
        toxic += [r["toxic"]] * len(runs)
    chain = Chain(features, np.zeros((3, len(features))), bias=-4.0)
    _fit(chain, known, ids, np.array(toxic, bool), suspects, steps, rate, decay)
    chain.calibration = _calibrated(*_evidence(rows, chain))
    return chain


def _chain_rows(rows: DataFrame) -> DataFrame:
    """CHAIN_DOCS rows of the sample, half of them toxic, in order of hash, whose texts fit in CHAIN_CHARS together."""
    order = Window.partitionBy("toxic").orderBy("hash", "doc_id")
    sized = rows.select("doc_id", "toxic", F.length("text").alias("chars"), F.xxhash64("doc_id", F.lit(8)).alias("hash"))
    # a text that is long for the budget is left out at once, so that one can't take the others' room
    short = sized.where(F.col("chars") <= CHAIN_CHARS // 20)
    first = short.withColumn("k", F.row_number().over(order)).withColumn("sum", F.sum("chars").over(order))
    first = first.where((F.col("k") <= CHAIN_DOCS // 2) & (F.col("sum") <= CHAIN_CHARS // 2)).select("doc_id", "hash")
    return rows.join(F.broadcast(first), "doc_id").orderBy("hash", "doc_id").select("text", "toxic")


def _fit(chain: Chain, known: Lexicon, ids: list[np.ndarray], toxic: np.ndarray, suspects: set[int], steps: int, rate: float, decay: float) -> None:
    """Gradient ascent on the likelihood of token labels; sets the chain's weights, bias and transitions."""
    links, size, many = known.taken(), len(known), len(chain.features)
    suspect = np.zeros(size, bool)
    suspect[links[np.isin(links[:, 1], list(suspects)), 0]] = True
    flat = np.concatenate([np.zeros(0, np.int32), *ids])
    lengths = np.array([len(x) for x in ids], np.int64)
    if not len(flat):
        return
    gold = (suspect[flat] & np.repeat(toxic, lengths)).astype(float)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    inner = np.ones(len(flat), bool)  # tokens with one before them
    inner[starts[lengths > 0]] = False
    pairs = np.flatnonzero(inner)
    scale = max(1.0, gold.sum())
    states = np.bincount((2 * gold[pairs - 1] + gold[pairs]).astype(int), minlength=4).reshape(2, 2)

    def summed(theta: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(links[:, 0], t[links[:, 1]], size) for t in theta])

    def spread(by_word: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(links[:, 1], g[links[:, 0]], many) for g in by_word])

    moments: dict[str, list] = {}

    def step(name: str, value: np.ndarray, gradient: np.ndarray, k: int) -> np.ndarray:
        m, v = moments.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient**2 - v)
        return value + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)

    for k in range(1, steps + 1):
        e = chain.emissions(flat, summed(chain.theta), starts, lengths)
        odds, r, s = chain.marginals(e, starts, lengths)
        off = gold - odds / (1 + odds)
        grads = np.zeros((3, size))
        grads[1] = np.bincount(flat, off, size)
        grads[0] = np.bincount(flat[pairs - 1], off[pairs], size)
        grads[2] = np.bincount(flat[pairs], off[pairs - 1], size)
        # expected transitions: forward odds before, backward odds after
        a, before, here = np.exp(chain.transitions), r[pairs - 1], np.exp(e[pairs]) * s[pairs]
        parts = (a[0, 0] + 0 * here, a[0, 1] * here, a[1, 0] * before, a[1, 1] * before * here)
        whole = sum(parts)
        expected = np.array([(x / whole).sum() for x in parts]).reshape(2, 2)
        chain.theta = step("w", chain.theta, spread(grads) / scale - decay * chain.theta, k)
        chain.bias = float(step("b", np.array([chain.bias]), np.array([off.sum() / scale]), k)[0])
        chain.transitions = np.clip(step("t", chain.transitions, (states - expected) / scale - decay * chain.transitions, k), -8, 8)


def _evidence(rows: DataFrame, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """The documents' features of rows (text, toxic), and the labels; five numbers a row reach the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts, at in _steps(b.column(1)):
                f = shared.value.batch(texts)[2]
                ids, toxic = (b.column(c).slice(at, len(texts)) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, toxic, *map(pa.array, f.T)], ["doc_id", "toxic", *"abcde"])

    kind = dict(rows.dtypes)["doc_id"]
    found = rows.select("doc_id", "text", "toxic").mapInArrow(run, f"doc_id {kind}, toxic int, a double, b double, c double, d double, e double")
    found = found.orderBy("doc_id").toArrow()  # sums in one order give one result
    return np.column_stack([found.column(c).to_numpy() for c in "abcde"]), found.column("toxic").to_numpy().astype(float)


def _steps(texts: pa.Array) -> Iterator[tuple[list[str | None], int]]:
    """Runs of texts of about STEP_CHARS characters, and where each begins; a longer text is a run of its own."""
    whole, size, first = texts.to_pylist(), 0, 0
    for i, t in enumerate(whole):
        n = len(t or "")
        if i > first and size + n > STEP_CHARS:
            yield whole[first:i], first
            size, first = 0, i
        size += n
    if whole:
        yield whole[first:], first


def _calibrated(features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, slightly regularised."""
    w = np.zeros(features.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (features.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        hessian = (features * (p * (1 - p))[:, None]).T @ features + ridge + 1e-9 * np.eye(len(w))
        w += np.linalg.solve(hessian, features.T @ (y - p) - ridge @ w)
    return w


def sample(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, toxic (0 or 1) of up to `rows` labelled documents with learn true for their doc_id: a staged table."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(learn)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = first_by_hash(known, rows, F.xxhash64("doc_id", F.lit(6)), "doc_id")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return staged(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "labelled")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))


def score(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted (1 from 0.5) and spans: offending tokens with offsets in code points and marginals."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Chain = shared.value
        for b in batches:
            for texts, at in _steps(b.column(1)):
                p, starts, features = model.batch(texts)
                scores = model.scores(features)
                spans: list[list[dict]] = [[] for _ in texts]
                hot = np.flatnonzero(p >= SPAN_MARGINAL)
                owners = np.searchsorted(starts, hot, side="right") - 1
                ds, cuts = np.unique(owners, return_index=True)
                for d, mine in zip(ds, np.split(hot, cuts[1:]) if len(ds) else [], strict=True):
                    found = [m.span() for m in _TOKEN.finditer(texts[d])]
                    spans[d] = [{"start": found[t - starts[d]][0], "end": found[t - starts[d]][1], "marginal": float(p[t])} for t in mine]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, _SPANS)],
                    ["doc_id", "score", "predicted", "spans"],
                )

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.dtypes[0][1]
    return source.mapInArrow(run, f"doc_id {kind}, score double, predicted int, spans array<struct<start: bigint, end: bigint, marginal: double>>")
