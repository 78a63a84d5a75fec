"""Scoring by a Brown class-based bigram model, with an add-half unigram model beside it.

Tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then one end. Texts are cut and hashed as byte arrays; a word
is its 64-bit hash from there on. Learning, from all training texts:
  1. Exact counts of all tokens, pre-aggregated in each task, then summed by word: a staged table as large as the
     vocabulary, which never comes to the driver.
  2. Exchange clustering of the most frequent words (UNITS), on the driver, over the matrix of their bigrams: words move
     between classes while the likelihood of the class bigrams grows. The end and all other words are classes of their
     own then.
  3. Every other word that occurs CLUSTER_COUNT times leaves the class of all others: a distributed pass counts the
     classes before and after it, and one exchange step, on the executors, moves it to the class that raises the
     likelihood most. Only rarer words stay, as a class whose transitions are trained like any other's.
  4. The class bigrams are counted again with the last classes.
  5. P(token | before) = P(class | class before) * P(token | class), both smoothed.
Words of a class of their own choice, with counts, are broadcast: 17 bytes for each, CLASS_WORDS at most; in a corpus
with more, the threshold rises to the least count that fits. All others keep exact counts in the table.

Scoring is one pass that sums what the broadcast words give, and sends a row for each rare word of a document; these
are joined with the counts and summed by document. No text is shuffled, and no group grows with the corpus: a broadcast
word costs nothing, a rare word has few uses.

Defined results: null text counts as empty, which has one token, the end; repeated rows score alike, very long texts as
a whole; without training documents N, V and all counts are 0, and the scores are what smoothing alone gives; a null id
isn't held out; of equally frequent words those with smaller hashes come first; an empty table gives an empty result;
only the id and the text are read, whatever other columns are called. Two words with one hash would count as one: for
10^7 words the chance that there is any such pair is about 10^-5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftline.plans.staging import staged

#: Words that exchange clustering moves on the driver.
UNITS = 768
CLASSES = 120
SWEEPS = 12
#: Words that occur so often get a class of their own choice; fewer uses say too little.
CLUSTER_COUNT = 3
#: Words with such a class, at most; they are broadcast.
CLASS_WORDS = 4_000_000
#: Words whose neighbours are counted together, about, and neighbours that a task holds (under 2^24).
PART_WORDS, HELD_NEIGHBOURS = 10_000, 2_000_000
#: Bytes of text that are cut into words at a time, about; a longer text by itself.
CHUNK_BYTES = 2_000_000
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 400_000
ADD = 0.5
#: Classes of the end, and of all words without a class of their own choice.
END_CLASS, REST_CLASS, FIXED = 0, 1, 2

U = np.uint64
#: What stands for the end among the words' hashes.
END = U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def held_out(doc_id: Column, remainder: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == remainder, F.lit(False))


# --- words as hashes ---


class _Powers:
    """Powers of the hash's base, and of its inverse, modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        inverse = pow(_BASE, -1, 1 << 64)
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * U(pow(_BASE, k, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * U(pow(inverse, k, 1 << 64))))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def cut(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of concatenated UTF-8 texts, and how many words each has; starts: where the texts begin."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins or all end here
    edge[starts] = True
    edge[-1] = True
    after_space = np.ones(len(data) + 1, bool)
    after_space[1:] = space
    first = np.flatnonzero(~space & (after_space[:-1] | edge[:-1]))
    before_space = np.append(space[1:], True) if len(data) else np.zeros(0, bool)
    last = np.flatnonzero(~space & (before_space | edge[1:])) + 1
    up, down = _POWERS(len(data) + 1)
    # a hash is the sum of the word's bytes times powers of the base: a difference of running sums, moved to the word's start
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((_LOWER[data].astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    h = _scrambled((sums[last] - sums[first]) * down[first] + (last - first).astype(U) * U(0xD1B54A32D192ED03))
    h[h == END] = U(2)
    of = np.searchsorted(starts, first, side="right") - 1
    return h, np.bincount(of, minlength=len(starts))


def hashes_of(words: list[bytes]) -> np.ndarray:
    """Hashes of single words; the empty word is the end."""
    full = [w for w in words if w]
    out = np.full(len(words), END)
    if full:
        data = np.frombuffer(b" ".join(full), np.uint8)
        out[[i for i, w in enumerate(words) if w]] = cut(data, np.zeros(1, np.int64))[0]
    return out


def sequences(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of runs of texts: hashes of all tokens, an end first and after each text; how many words each has; the first's place."""
    if not len(texts):
        return
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        h, n = cut(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
        out = np.full(len(h) + len(n) + 1, END)
        out[1 + np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        yield out, n, i
        i = j


# --- counts ---


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash), c: exact counts of all tokens of the column text, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n = np.zeros(0, U), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for tokens, _, _ in sequences(b.column(0)):
                held.append(tokens[1:])
                size += len(tokens)
                if size > 4 * HELD_WORDS:
                    word, n = _merged(word, n, held)
                    held, size = [], 0
                    if len(word) > HELD_WORDS:
                        yield from _counted(word, n)
                        word, n = word[:0], n[:0]
        yield from _counted(*_merged(word, n, held))

    return texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def _merged(word: np.ndarray, n: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new, times = np.unique(np.concatenate([np.zeros(0, U), *held]), return_counts=True)
    if not len(word):
        return new, times
    both, at = np.unique(np.concatenate((word, new)), return_inverse=True)
    return both, np.bincount(at, np.concatenate((n, times)), len(both)).astype(np.int64)


def _counted(word: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(word), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(word[i : i + 200_000].view(np.int64)), pa.array(n[i : i + 200_000])], ["word", "n"])


def most_frequent(counts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the n most frequent words, the most frequent first; of equal counts, smaller hashes first.

    A histogram of counts (a bin for each to 64, then 64 to a doubling) gives the last bin that is needed; of its words a
    share by hash comes along, a little more than needed. So no task sends more than its share.
    """
    bin_ = F.when(F.col("c") < 64, F.col("c")).otherwise(F.floor(F.log2("c") * 64) - 6 * 64 + 64)
    bins = {r["bin"]: r["words"] for r in counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("words")).collect()}
    least, share, room = None, 1.0, n
    for b in sorted(bins, reverse=True):
        least = b
        if bins[b] > room:
            # hashes are spread evenly: a bound on them leaves a share of the last bin
            share = min(1.0, (room + 6 * room**0.5 + 20) / bins[b])
            break
        room -= bins[b]
    if least is None:
        return np.zeros(0, U), np.zeros(0, np.int64)
    bound = min(int(-(2**63) + share * 2**64), 2**63 - 1)
    found = counts.where((bin_ > least) | (bin_ == least) & (F.col("word") <= bound)).select("word", "c").toArrow()
    word, c = found.column("word").to_numpy(), found.column("c").to_numpy()
    order = np.lexsort((word, -c))[:n]
    return word[order].view(U), c[order]


# --- classes ---


class Lookup:
    """Places of hashes in a sorted table of them, -1 where they aren't in it."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.sorted, tokens), len(self.sorted) - 1)
        return np.where(self.sorted[at] == tokens, self.order[at], -1)


def _bigrams(texts: DataFrame, size: int, shared, of) -> np.ndarray:
    """How often each number follows each other; of: from the broadcast value to a function of tokens to numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, cells = of(shared.value), np.zeros(size * size, np.int64)
        for b in batches:
            for tokens, _, _ in sequences(b.column(0)):
                k = numbers(tokens)
                cells += np.bincount(k[:-1] * size + k[1:], minlength=size * size)
        full = np.flatnonzero(cells)
        for i in range(0, len(full), 100_000):
            at = full[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], ["cell", "n"])

    found = texts.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def _unit_numbers(units: np.ndarray):
    """0 for the end, 1 for words that aren't units, then the units."""
    look = Lookup(units)

    def numbers(tokens: np.ndarray) -> np.ndarray:
        at = look(tokens) + FIXED
        at[at < FIXED] = 1
        at[tokens == END] = 0
        return at

    return numbers


def _xlogx(x: np.ndarray | float) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, fixed: int = FIXED, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit. The first `fixed` units are classes of their own, and so are the most frequent others at first.

    In sweeps over the units by frequency, each of them joins, or moves to, the class with the highest class bigram
    likelihood, until a sweep moves none. Bigrams with units that haven't joined yet don't count.
    """
    size = len(bigrams)
    m = bigrams.astype(float)
    order = np.argsort(-(m.sum(0) + m.sum(1)), kind="stable")
    order = order[order >= fixed]
    of = np.full(size, classes)  # beyond the classes: not joined yet
    of[:fixed] = np.arange(fixed)
    seeds = order[: max(0, classes - fixed)]
    of[seeds] = fixed + np.arange(len(seeds))
    onehot = np.zeros((size, classes + 1))
    onehot[np.arange(size), of] = 1
    table = (onehot.T @ m @ onehot)[:classes, :classes]
    for _ in range(sweeps):
        moved = 0
        for u in order:
            self_, old = m[u, u], of[u]
            after = np.bincount(of, m[u], classes + 1)
            before = np.bincount(of, m[:, u], classes + 1)
            after[old] -= self_
            before[old] -= self_
            after, before = after[:classes], before[:classes]
            if old < classes:
                table[old] -= after
                table[:, old] -= before
                table[old, old] -= self_
            rows, cols = table.sum(1), table.sum(0)
            now = _xlogx(table)
            gain = (_xlogx(table + after) - now).sum(1) + (_xlogx(table + before[:, None]) - now).sum(0)
            d = np.diag(table)
            gain += _xlogx(d + after + before + self_) + _xlogx(d) - _xlogx(d + after) - _xlogx(d + before)
            gain -= _xlogx(rows + after.sum() + self_) - _xlogx(rows) + _xlogx(cols + before.sum() + self_) - _xlogx(cols)
            new = fixed + int(np.argmax(gain[fixed:]))
            if old < classes and gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            of[u] = new
            table[new] += after
            table[:, new] += before
            table[new, new] += self_
        if not moved:
            break
    return of


def _packed_neighbours(keys: list[np.ndarray], chosen: np.ndarray, width: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Counts by word and neighbour class, a row for each part of the words: 8 bytes a word, 4 a count."""
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    place = key // width
    first = np.flatnonzero(np.diff(place, prepend=-1))
    lengths = np.diff(np.append(first, len(key)))
    cells = ((key % width) << 24 | n).astype(np.uint32)
    part = place[first] * parts // len(chosen)
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(part)), strict=True):
        begin, end = first[a], first[b] if b < len(first) else len(key)
        columns = [pa.array([int(part[a])], pa.int32())]
        columns += [pa.array([x.tobytes()], pa.binary()) for x in (place[first[a:b]], lengths[a:b].astype(np.uint16), cells[begin:end])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "places", "lengths", "cells"])


def best_classes(texts: DataFrame, units: np.ndarray, of: np.ndarray, table: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The class of each of the chosen words (sorted hashes) that raises the likelihood of the class bigrams `table` most.

    A word is taken out of the class of all others first. With the others fixed, the gain is linear in the counts of the
    classes before and after the word; tasks send those. Classes are below 128.
    """
    size = len(table)
    parts = -(-len(chosen) // PART_WORDS)
    smooth = table + 5 * (table.sum(0) + 1) / (table.sum() + size)
    shared = texts.sparkSession.sparkContext.broadcast((units, of, chosen))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, of, chosen = shared.value
        numbers, look, keys, held = _unit_numbers(units), Lookup(chosen), [], 0
        for b in batches:
            for tokens, _, _ in sequences(b.column(0)):
                k, at = of[numbers(tokens)], look(tokens)
                where = np.flatnonzero(at >= 0)  # never an end, so neighbours are of the same document
                for i in range(0, len(where), HELD_NEIGHBOURS // 2):
                    x = where[i : i + HELD_NEIGHBOURS // 2]
                    if held and held + 2 * len(x) > HELD_NEIGHBOURS:
                        yield from _packed_neighbours(keys, chosen, 2 * size, parts)
                        keys, held = [], 0
                    base = at[x] * (2 * size)
                    keys += [base + k[x - 1], base + size + k[x + 1]]
                    held += 2 * len(x)
        if held:
            yield from _packed_neighbours(keys, chosen, 2 * size, parts)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for part, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                places, lengths, cells = (np.frombuffer(x, t) for x, t in zip(rest, (np.int64, np.uint16, np.uint32), strict=True))
                low = -(-part * len(chosen) // parts)
                high = -(-(part + 1) * len(chosen) // parts)
                counts = dense.setdefault(part, (low, np.zeros((high - low) * 2 * size)))[1]
                at = np.repeat(places - low, lengths) * (2 * size) + (cells >> 24)
                counts += np.bincount(at, cells & np.uint32((1 << 24) - 1), len(counts))
        for low, flat in dense.values():
            both = flat.reshape(-1, 2, size)
            before, after, n = both[:, 0], both[:, 1], both[:, 0].sum(1)
            logs, rows, cols = np.log(smooth), smooth.sum(1), smooth.sum(0)
            gain = before @ logs + after @ logs.T - n[:, None] * (np.log(rows) + np.log(cols))
            best = FIXED + np.argmax(gain[:, FIXED:], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + len(best))), pa.array(best.astype(np.int32))], ["place", "class"])

    sent = texts.mapInArrow(neighbours, "part int, places binary, lengths binary, cells binary")
    found = sent.repartition(parts, "part").mapInArrow(assigned, "place bigint, class int").toArrow()
    out = np.full(len(chosen), REST_CLASS, np.uint8)
    out[found.column("place").to_numpy()] = found.column("class").to_numpy()
    return out


# --- the model ---


@dataclass
class Model:
    n: int  # training tokens
    v: int  # distinct ones
    words: np.ndarray  # sorted hashes of the words with a class of their own choice, the end among them
    counts: np.ndarray
    of: np.ndarray  # their classes
    transition: np.ndarray  # log10 P(class | class before)
    class_tokens: np.ndarray
    class_words: np.ndarray

    def numbers(self):
        """A function of tokens to the places of their words, -1 for all others."""
        return Lookup(self.words)

    def classes(self, words: list[bytes]) -> np.ndarray:
        at = self.numbers()(hashes_of(words))
        return np.where(at >= 0, self.of[at], REST_CLASS) if len(self.words) else np.full(len(words), REST_CLASS)


def _class_numbers(model: Model):
    look = model.numbers()
    of = np.append(model.of, REST_CLASS).astype(np.int64)  # the last one is for place -1
    return lambda tokens: of[look(tokens)]


def learn(texts: DataFrame, units: int = UNITS, classes: int = CLASSES, cluster_count: int = CLUSTER_COUNT, class_words: int = CLASS_WORDS) -> tuple[Model, DataFrame]:
    """The model, and the staged table of counts (word, c), from the column text."""
    counts = staged(word_counts(texts), "counts")
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    end = int(END)
    ends = counts.where(F.col("word") == end).agg(F.sum("c")).first()[0] or 0
    often = counts.where((F.col("c") >= cluster_count) & (F.col("word") != end))
    words, times = most_frequent(often, class_words)
    single = words[:units]
    # words of one class alone can't be told apart: with too few classes all stay together
    of_unit = np.arange(FIXED)
    table = np.zeros((classes, classes))
    of = np.full(len(words), REST_CLASS, np.uint8)
    if classes > FIXED and len(words):
        spark = texts.sparkSession.sparkContext
        bigrams = _bigrams(texts, len(single) + FIXED, spark.broadcast(single), _unit_numbers)
        of_unit = exchange(bigrams, FIXED, classes)
        onehot = np.zeros((len(of_unit), classes))
        onehot[np.arange(len(of_unit)), of_unit] = 1
        table = onehot.T @ bigrams @ onehot
        of[: len(single)] = of_unit[FIXED:]
        rest = np.sort(words[len(single) :])
        if len(rest):
            best = best_classes(texts, single, of_unit, table, rest)
            of[len(single) :] = best[np.searchsorted(rest, words[len(single) :])]
    order = np.argsort(np.append(words, END), kind="stable")
    none = np.zeros(classes, np.int64)
    model = Model(int(n or 0), int(v), np.append(words, END)[order], np.append(times, ends)[order], np.append(of, END_CLASS)[order].astype(np.uint8), none, none, none)
    shared = texts.sparkSession.sparkContext.broadcast(model)
    table = _bigrams(texts, classes, shared, _class_numbers)
    kinds = np.bincount(model.of[model.counts > 0], minlength=classes)
    kinds[REST_CLASS] += model.v - int((model.counts > 0).sum())
    model.class_tokens, model.class_words = table.sum(0), kinds
    share = (model.class_tokens + 1) / (model.class_tokens.sum() + classes)
    model.transition = np.log10((table + 5 * share) / (table.sum(1, keepdims=True) + 5))
    return model, counts


# --- scores ---

_ROWS = "kind string, doc bigint, doc_id {}, n_tokens bigint, n_known bigint, base double, score double, word bigint, times bigint"


def score(docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text) and perplexity of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType.fromDDL(_ROWS.format(dict(rows.dtypes)["doc_id"]))
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        look = model.numbers()
        of = np.append(model.of, REST_CLASS).astype(np.int64)
        c = np.append(model.counts, 0).astype(float)
        base_total = model.n + ADD * (model.v + 1)
        class_total = (model.class_tokens + ADD * (model.class_words + 1))[of]
        # words that aren't in the model get what their counts add later
        over = np.append(np.log10(c[:-1] + ADD), 0.0)
        base, emission = over - np.log10(base_total), over - np.log10(class_total)
        known = c > 0
        doc = TaskContext.get().partitionId() << 40
        for b in batches:
            for tokens, n, i in sequences(b.column(1)):
                at = look(tokens)
                k = of[at]
                ends = np.concatenate(([0], np.cumsum(n + 1)))
                total = lambda x: np.add.reduceat(x, ends[:-1]) if len(x) else x  # noqa: E731, B023
                step = emission[at[1:]] + model.transition[k[:-1], k[1:]]
                yield _rows(
                    fields,
                    kind=["document"] * len(n),
                    doc=np.arange(doc, doc + len(n)),
                    doc_id=b.column(0).slice(i, len(n)),
                    n_tokens=n + 1,
                    n_known=total(known[at[1:]].astype(np.int64)),
                    base=total(base[at[1:]]),
                    score=total(step),
                )
                rare = np.flatnonzero(at[1:] < 0)
                if len(rare):
                    word, owner = tokens[1:][rare], np.searchsorted(ends, rare, side="right") - 1
                    order = np.lexsort((word, owner))
                    word, owner = word[order], owner[order]
                    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])))
                    times = np.diff(np.append(first, len(word)))
                    yield _rows(fields, kind=["word"] * len(first), doc=doc + owner[first], word=word[first].view(np.int64), times=times)
                doc += len(n)

    found = staged(rows.mapInArrow(run, schema), "scored", "kind")
    rest = counts.where(F.col("word") != int(END)).select("word", "c")
    words = found.where("kind = 'word'").select("doc", "word", "times").join(rest, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = words.groupBy("doc").agg(F.sum(F.col("times") * F.log10(c + ADD)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("seen"))
    full = found.where("kind = 'document'").drop("kind", "word", "times").join(sums, "doc", "left")
    more = F.coalesce("more", F.lit(0.0))
    total = F.col("score") + more
    return full.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), F.least(-total / F.col("n_tokens"), F.lit(300.0))).alias("perplexity"),
    )


def _rows(fields: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of score()'s pass; columns that aren't given are null."""
    n = len(columns["kind"])
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields]
    return pa.RecordBatch.from_arrays(arrays, schema=fields)
