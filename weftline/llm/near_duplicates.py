"""N-gram Jaccard join by PartEnum signatures; exact, from candidates to classes.

Sets are distinct word shingles (64-bit hashes). Two sets with Jaccard similarity of at least T percent have sizes in the
same or in neighbouring bands (a band ends where its first size, divided by T percent, ends), and a Hamming distance of
at most k = (100 - T) * (a + b) / (100 + T). Each set signs in the instances of its band and of the next one. In an
instance, the hash domain is partitioned into n1 = k // (k2 + 1) + 1 + m parts, each of these into n2 smaller ones, and
every subset of n2 - k2 smaller parts of a part gives a signature of its elements. Differences leave at least m + 1 parts
with k2 differences at most, and in such a part some subset without any: there both sets have the same signature. A
subset without elements signs nothing; if a set has no more than m parts with such a subset, one of the m + 1 is not among
them. A set with more of them signs under a further partition as well, and after the last one in a common bucket of its
instance; so no similar pair is lost for any sets. Where k is 0, similar sets are equal. `scheme` picks k2 and n2.

Work, in this order:
  1. One pass over the texts gives each set's identity (128 bits), sketch and signatures. A task signs a set once, however
     many copies it meets, and sends its signatures in packed columns, some four bytes each: the signature's remainder in
     its range, the set's number in the task. A signature that many sets of a task have travels apart and is never
     gathered.
  2. Equal sets are one node. Buckets (signatures of two nodes or more) with the same members are one bucket.
  3. First round: each node with the most central node of its buckets: groups of near copies collapse around their hub, by
     one verified link for each node instead of all pairs.
  4. Second round: in each bucket that still holds nodes of different components, all pairs of different components face
     an exact bound (sizes, then the parity of hashed elements, which can't exceed the Hamming distance). Pairs that pass
     are verified on the sets, which are read from the texts again. A bucket with many more such pairs than nodes gives
     each node's nearest partner only, and stays open.
  5. Third round: the open buckets get the sets themselves; their pairs are verified on the spot, and only links that
     join two components are written.
After it, every pair of nodes that share a signature and are in different components has failed the bound or the
verification: no link is lost, and none of a dense group's inner pairs is written out.

Buckets of the second and third round stream in sorted order; one of them is held with its sketches (a bit for a half to
a quarter of an element), open ones with their sets.

Defined results: words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; null, empty and blank texts have the empty set
and are linked with nothing; a text shorter than a shingle has one shingle of all its words; very long texts are sets like
others, never cut; repeated rows are linked; of equal ids and of ties nothing depends on their order; component ids ignore
null ids (null only where all ids of a component are null); empty tables give empty results; of docs only the id and the
text are read, and one_of_each returns all its columns, whatever their names. A pair of equal 64-bit hashes of different
shingles in one document would count as one: less than 1 in 10^8 for a document of 10^5 words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graph import components
from weftline.plans.staging import discard, staged

WIDTH, PERCENT = 4, 85
#: Partitions tried for sets with too many empty subsets.
SEEDS = 6
#: A signature should have so many elements on average, where a band's sizes allow it.
ELEMENTS = 2
#: Signatures that come together in a task, about, and how many a character of text gives, about.
BUCKET_SIGNATURES, SIGNATURES_PER_CHAR = 500_000, 0.2
#: Tasks that the signatures are dealt to, at most: a task holds what it reads.
PARTITIONS = 20_000
#: Sets and signatures that a task packs together; numbers of sets are of 16 bits.
PACKED_SETS, PACKED_SIGNATURES = 1 << 16, 1_000_000
#: A signature that so many of them have travels apart.
HOT = 64
#: Members in a row of a bucket.
ROW_MEMBERS = 4096
#: One bucket in so many guides the first round.
GUIDE = 2
#: Words whose hashes, and sets whose identities, a task remembers.
HELD_WORDS, HELD_SETS = 250_000, 100_000
#: Bits of the bitmap that tells which documents' sets are needed, at most (16 MB, at any number of documents).
BITMAP = 1 << 27
#: Pairs for each node from which a bucket gives nearest partners only.
DENSE = 4
#: Nodes up to this many are broadcast to pick out their sets (40 bytes each).
BROADCAST_NODES = 200_000
#: Ids of documents that leave, up to which they are broadcast (16 bytes each).
BROADCAST_GONE = 2_000_000
#: Pairs of one node that are verified in one task.
GROUP_PAIRS = 512
#: Pairs compared at a time in a bucket.
CHUNK = 1 << 20

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < HELD_WORDS:
            self[word] = h
        return h


def shingle_set(text: str | None, width: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return np.zeros(0, U)
    h = np.fromiter(map(hashes.__getitem__, ws), U, len(ws))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, U)
    for j in range(k):
        out = mixed(out * U(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def identity(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for a set."""
    sums = [mixed(s ^ U(c)).sum(dtype=U) + U(len(s)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    hi, lo = mixed(np.array(sums, U)).view(np.int64).tolist()
    return hi, lo


# --- bands and parts ---


@lru_cache(maxsize=None)
def _empty_subset(mean: float, n2: int, k2: int) -> float:
    """Chance that some n2 - k2 of n2 parts have no element, by Poisson: at least n2 - k2 parts are empty."""
    e = math.exp(-mean)
    return sum(math.comb(n2, i) * e**i * (1 - e) ** (n2 - i) for i in range(n2 - k2, n2 + 1))


@lru_cache(maxsize=None)
def scheme(k: int, typical: int) -> tuple[int, int, int, int]:
    """n1, m, n2, k2 for a distance of k and sets of a typical size.

    Of the schemes with subsets of two or three smaller parts, the one with the fewest signatures among those whose
    signatures have ELEMENTS elements; else the one with most elements.
    """
    found = []
    for k2 in range(1, min(k, 4) + 1):
        for n2 in (k2 + 2, k2 + 3):
            m = 0
            while True:
                n1 = k // (k2 + 1) + 1 + m
                expected = n1 * _empty_subset(typical / n1 / n2, n2, k2)
                if expected + 2 * math.sqrt(expected) < m + 1 or m > k:
                    break
                m += 1
            elements = typical * (n2 - k2) / (n1 * n2)
            found.append((elements < ELEMENTS, n1 * math.comb(n2, k2) if elements >= ELEMENTS else -elements, -elements, (n1, m, n2, k2)))
    return min(found)[-1]


@lru_cache(maxsize=None)
def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sizes of the bands; of each instance k, and n1, m, n2, k2 (0 where k is 0)."""
    first, last = [1], []
    while first[-1] <= largest:
        last.append(first[-1] * 100 // percent)
        first.append(last[-1] + 1)
    last.append(first[-1] * 100 // percent)
    ks = [(100 - percent) * 2 * r // (100 + percent) for r in last]
    schemes = [scheme(k, first[max(i - 1, 0)]) if k else (0, 0, 0, 0) for i, k in enumerate(ks)]
    return np.array(first), np.array(ks), np.array(schemes)


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of all sets, as arrays; vectorised over the sets of a scheme."""
    sizes = np.array([len(s) for s in sets], np.int64)
    top = int(sizes.max(initial=0))
    first, ks, schemes = bands(percent, 1 << max(4, top.bit_length()))
    band = np.searchsorted(first, sizes, side="right") - 1
    out_sig, out_of = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for shift in (0, 1):
        signing = np.flatnonzero((sizes > 0) & (ks[np.minimum(band + shift, len(ks) - 1)] > 0))
        kinds = schemes[band[signing] + shift][:, 2:]
        for n2, k2 in {tuple(x) for x in kinds.tolist()}:
            todo = signing[(kinds == (n2, k2)).all(1)]
            for seed in range(SEEDS):
                if not len(todo):
                    break
                instance = band[todo] + shift
                sig, holder, sparse = _enumerated([sets[i] for i in todo], schemes[instance, 0], instance, seed, n2, k2)
                out_sig.append(sig)
                out_of.append(todo[holder])
                todo = todo[sparse > schemes[instance, 1]]
            if len(todo):
                out_sig.append(mixed((band[todo] + shift).astype(U) + U(1 << 60)))
                out_of.append(todo)
    return np.concatenate(out_sig), np.concatenate(out_of)


def _enumerated(sets: list[np.ndarray], n1: np.ndarray, instance: np.ndarray, seed: int, n2: int, k2: int) -> tuple[np.ndarray, ...]:
    """Signatures, their sets, and of each set the number of parts with an empty subset."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    base = np.concatenate(([0], np.cumsum(n1)))
    h = mixed(flat + U(seed + 1))
    at = (base[owner] + (h % n1[owner].astype(U)).astype(np.int64)) * n2 + ((h >> U(40)) % U(n2)).astype(np.int64)
    sums = np.zeros(base[-1] * n2, U)
    np.add.at(sums, at, mixed(flat ^ U(0xD1B54A32D192ED03)))
    sums, full = sums.reshape(-1, n2), (np.bincount(at, minlength=base[-1] * n2) > 0).reshape(-1, n2)
    holder = np.repeat(np.arange(len(sets)), n1)
    place = (np.arange(base[-1]) - base[holder]).astype(U)
    key = mixed(mixed((instance[holder].astype(U) << U(8)) + U(seed)) + place * U(0x9E3779B97F4A7C15))
    out_sig, out_of = [], []
    for j, chosen in enumerate(combinations(range(n2), n2 - k2)):
        have = np.flatnonzero(full[:, chosen].any(1))
        sig = key[have] + U(j + 1)
        for c in chosen:
            sig = mixed(sig * U(0x9E3779B97F4A7C15) + sums[have, c])
        out_sig.append(sig)
        out_of.append(holder[have])
    sparse = np.bincount(holder[full.sum(1) <= k2], minlength=len(sets))
    return np.concatenate(out_sig), np.concatenate(out_of), sparse


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the elements hashed to a power of two of bits, 2 to 4 for each element, as 64-bit words."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    at = (mixed(s + U(0xA24BAED4963EE407)) & U(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(U)


def folded(words: np.ndarray, length: int) -> np.ndarray:
    """The sketch of the same set with fewer bits; bits are taken modulo the new number."""
    return np.bitwise_xor.reduce(words.reshape(-1, length), axis=0) if len(words) > length else words


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


# --- tasks of the first pass ---

_PACKED = "bucket int, hot boolean, base bigint, sigs binary, of binary, doc_id bigint, handle bigint, n bigint, hi bigint, lo bigint, sketch binary"
_FOUND = "kind string, doc_id bigint, handle bigint, n bigint, hi bigint, lo bigint, sketch binary, bid bigint, part bigint, members array<bigint>"
_FIELDS = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}


def _batch(schema: str, rows: int, **columns) -> pa.RecordBatch:
    """A batch of a schema; columns that aren't given are null."""
    kinds = dict(x.split(" ") for x in schema.split(", "))
    arrays = [pa.array(columns[c], _FIELDS[k]) if c in columns else pa.nulls(rows, _FIELDS[k]) for c, k in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, list(kinds))


def _packed(width: int, percent: int, buckets: int) -> Callable:
    """Rows (doc_id, text) to a row for each document, and packed signatures of the sets.

    A handle is the number of a set in its task; of equal sets, the task's first one. Recomputed tasks give the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = Hashes(), {}
        first = TaskContext.get().partitionId() << 40
        held: list[np.ndarray] = []  # sets to sign
        sigs, of, n_sigs, n_sets = [], [], 0, 0

        def signed() -> None:
            nonlocal n_sigs, n_sets
            sig, owner = signatures(held, percent)
            sigs.append(sig)
            of.append((owner + n_sets).astype(np.uint16))
            n_sigs, n_sets = n_sigs + len(sig), n_sets + len(held)
            held.clear()

        for b in batches:
            handles, n, hi, lo, sketches = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, width, hashes)
                one = identity(s) if len(s) else None
                new = one is not None and one not in known
                if new:
                    if len(known) >= HELD_SETS:
                        known.clear()
                    known[one] = first + n_sets + len(held)
                    held.append(s)
                n.append(len(s))
                handles.append(known[one] if one else None)
                hi.append(one[0] if new else None)
                lo.append(one[1] if new else None)
                sketches.append(sketch(s).tobytes() if new else None)
                if len(held) >= 256:
                    signed()
                    if n_sigs > PACKED_SIGNATURES or n_sets > PACKED_SETS - 512:
                        yield from _dealt(np.concatenate(sigs), np.concatenate(of), first, buckets)
                        sigs, of, n_sigs, n_sets, first = [], [], 0, 0, first + PACKED_SETS
            spread = [-1 - (h or 0) % buckets for h in handles]
            yield _batch(_PACKED, len(n), bucket=spread, hot=[False] * len(n), doc_id=b.column(0), handle=handles, n=n, hi=hi, lo=lo, sketch=sketches)
        signed()
        yield from _dealt(np.concatenate(sigs), np.concatenate(of), first, buckets)

    return run


def _steps(numbers: np.ndarray) -> bytes:
    """Numbers of 16 bits by their steps (modulo 2^16), all low bytes first: of rising ones the high bytes are mostly 0."""
    steps = np.diff(numbers, prepend=np.uint16(0))
    return (steps & 255).astype(np.uint8).tobytes() + (steps >> 8).astype(np.uint8).tobytes()


def _bucket_of(sig: np.ndarray, buckets: int) -> np.ndarray:
    return (((sig >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)


def _dealt(sig: np.ndarray, of: np.ndarray, base: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed signatures by bucket, and those that many of the sets have as rows of their own."""
    if not len(sig):
        return
    bins = (sig & U((1 << 20) - 1)).astype(np.int64)
    often = np.bincount(bins, minlength=1 << 20) >= HOT + len(sig) // (1 << 19)
    hot = np.flatnonzero(often[bins])
    if len(hot):
        hot = hot[np.argsort(sig[hot], kind="stable")]
        cuts = np.flatnonzero(np.diff(sig[hot], prepend=sig[hot[0]] ^ U(1)) != 0)
        hot = np.concatenate([np.zeros(0, np.int64), *(g for g in np.split(hot, cuts[1:]) if len(g) >= HOT)])
    if len(hot):
        groups = np.split(hot, np.flatnonzero(np.diff(sig[hot]) != 0) + 1)
        keys = sig[[g[0] for g in groups]]
        rest = keys.astype(np.uint32)
        yield _batch(
            _PACKED,
            len(groups),
            bucket=_bucket_of(keys, buckets),
            hot=[True] * len(groups),
            base=[base] * len(groups),
            sigs=[r.tobytes() for r in rest],
            of=[_steps(of[g]) for g in groups],
        )
        plain = np.ones(len(sig), bool)
        plain[hot] = False
        sig, of = sig[plain], of[plain]
    bucket = _bucket_of(sig, buckets)
    order = np.lexsort((of, bucket))
    present, at = np.unique(bucket[order], return_index=True)
    ends = np.append(at[1:], len(order))
    sigs, of = sig.astype(np.uint32)[order], of[order]
    for i in range(0, len(present), 512):
        cut = [slice(x, y) for x, y in zip(at[i : i + 512], ends[i : i + 512], strict=True)]
        parts = {"sigs": [sigs[c].tobytes() for c in cut], "of": [_steps(of[c]) for c in cut]}
        yield _batch(_PACKED, len(cut), bucket=present[i : i + 512], hot=[False] * len(cut), base=[base] * len(cut), **parts)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket, hot ones first: the documents' rows, and members of each signature with two sets or more."""
    now, hot, sigs, sets = None, set(), [], []
    for b in batches:
        documents = b.filter(b.column("base").is_null())
        if documents.num_rows:
            kept = {c: documents.column(c) for c in ("doc_id", "handle", "n", "hi", "lo", "sketch")}
            yield _batch(_FOUND, documents.num_rows, kind=["document"] * documents.num_rows, **kept)
        packs = b.filter(b.column("base").is_valid())
        for bucket, is_hot, base, sig, of in zip(*(packs.column(c).to_pylist() for c in ("bucket", "hot", "base", "sigs", "of")), strict=True):
            if bucket != now:
                yield from _members(now, hot, sigs, sets)
                now, hot, sigs, sets = bucket, set(), [], []
            low, high = np.frombuffer(of, np.uint8).reshape(2, -1)
            handles = np.cumsum(low + high.astype(np.int64) * 256) % PACKED_SETS + base
            if is_hot:
                key = int(np.frombuffer(sig, np.uint32)[0])
                hot.add(key)
                yield _rows(np.full(1, _hot_id(now, key)), np.array([0, len(handles)]), handles, np.full(1, base))
            else:
                sigs.append(np.frombuffer(sig, np.uint32))
                sets.append(handles)
    yield from _members(now, hot, sigs, sets)


def _hot_id(bucket: int, key: int) -> int:
    return int(mixed(np.array([(bucket << 32) + key], U)).view(np.int64)[0])


def _members(bucket: int | None, hot: set[int], sigs: list[np.ndarray], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if not sigs:
        return
    sig, of = np.concatenate(sigs), np.concatenate(sets)
    order = np.lexsort((of, sig))
    sig, of = sig[order], of[order]
    start = np.flatnonzero(np.diff(sig.astype(np.int64), prepend=-1))
    size = np.diff(np.append(start, len(sig)))
    apart = np.isin(sig[start], np.array(sorted(hot), np.uint32))
    for i in np.flatnonzero(apart):
        # the rest of a hot signature's members, whose number in this task doesn't matter
        own = of[start[i] : start[i] + size[i]]
        yield _rows(np.full(1, _hot_id(bucket, int(sig[start[i]]))), np.array([0, len(own)]), own, np.full(1, -1))
    keep = (size > 1) & ~apart
    if keep.any():
        member = of[np.repeat(keep, size)]
        ends = np.concatenate(([0], np.cumsum(size[keep])))
        content = [np.add.reduceat(mixed(member.astype(U) ^ U(c)), ends[:-1]) for c in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]
        ids, parts = (mixed(c + size[keep].astype(U)).view(np.int64) for c in content)
        step = 20_000
        for i in range(0, len(ids), step):
            e = ends[i : i + step + 1]
            yield _rows(ids[i : i + step], e - e[0], member[e[0] : e[-1]], parts[i : i + step])


def _rows(ids: np.ndarray, ends: np.ndarray, member: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    """Rows of buckets, of ROW_MEMBERS members at most; equal buckets have equal rows."""
    sizes = np.diff(ends)
    pieces = -(-sizes // ROW_MEMBERS)
    of = np.repeat(np.arange(len(ids)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = ends[of] + nth * ROW_MEMBERS
    part = mixed(parts[of].astype(U) + nth.astype(U)).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, ends[-1]).astype(np.int32)), pa.array(member))
    return _batch(_FOUND, len(of), kind=["bucket"] * len(of), bid=ids[of], part=part, members=lists)


# --- sets, read from the texts again ---


def _bits(needed: DataFrame, column: str, size: int) -> bytes:
    """A bitmap of the column's values modulo size."""
    x = F.pmod(F.col(column), F.lit(size))
    parts = needed.select(F.bitmap_bucket_number(x + 1).alias("k"), F.bitmap_bit_position(x + 1).alias("p"))
    out = bytearray(max(size // 8, 4096))
    for r in parts.groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).collect():
        at = (r["k"] - 1) * 4096
        out[at : at + 4096] = bytes(r["bits"])
    return bytes(out)


class Texts:
    """The documents of a join, and which of them has each node's set (reps: node, doc_id, hi, lo)."""

    def __init__(self, rows: DataFrame, reps: DataFrame, width: int):
        self.rows, self.reps, self.width = rows, reps, width

    def sets(self, need: DataFrame) -> DataFrame:
        """need (a table with node, staged) plus elements, the sorted hashes of the node's set.

        Only documents whose ids are in a bitmap of those needed are split into words again; the identity then decides.
        """
        found = self.reps.join(need.select("node").distinct(), "node", "left_semi")
        found = staged(found, "needed")
        n = found.count()
        size = min(BITMAP, 1 << max(16, (16 * n).bit_length()))
        context = self.rows.sparkSession.sparkContext
        named = context.broadcast(_bits(found.where("doc_id IS NOT NULL"), "doc_id", size))
        # a set that stands only in documents without an id is found by its identity
        nameless = found.where("doc_id IS NULL")
        unnamed = None if nameless.isEmpty() else context.broadcast(_bits(nameless, "lo", size))
        sets = self.rows.mapInArrow(_needed_sets(self.width, size, named, unnamed), "hi bigint, lo bigint, elements binary")
        ids = found.select("hi", "lo", "node")
        if n <= BROADCAST_NODES:
            ids = F.broadcast(ids)
        return sets.join(ids, ["hi", "lo"]).select("node", "elements").join(F.broadcast(need) if n <= BROADCAST_NODES and need.count() <= BROADCAST_NODES else need, "node")


def _needed_sets(width: int, size: int, named, unnamed) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, wanted = Hashes(), np.frombuffer(named.value, np.uint8)
        by_set = np.frombuffer(unnamed.value, np.uint8) if unnamed else None
        for b in batches:
            ids = b.column(0)
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            at = ids.fill_null(0).to_numpy(zero_copy_only=False) % size
            ok = ((wanted[at >> 3] >> (at & 7)) & 1 > 0) & valid
            at = np.flatnonzero(ok if by_set is None else ok | ~valid)
            for i in range(0, len(at), 1000):
                few = at[i : i + 1000]
                sets = [(j, s) for j, t in zip(few, b.column(1).take(pa.array(few)).to_pylist(), strict=True) if len(s := shingle_set(t, width, hashes))]
                full = [(*identity(s), s.tobytes()) for j, s in sets if valid[j] or by_set[(k := identity(s)[1] % size) >> 3] >> (k & 7) & 1]
                columns = zip(*full, strict=True) if full else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["hi", "lo", "elements"])

    return run


def _verified(percent: int) -> Callable:
    """Of rows (a, salt, lead, node, elements), sorted, the lead's set first: the pairs of similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead = None, np.zeros(0, U)
        for b in batches:
            out = []
            for a, salt, first, node, elements in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if first:
                    key, lead = (a, salt), np.frombuffer(elements, U)
                elif (a, salt) == key and similar(lead, np.frombuffer(elements, U), percent):
                    out.append((a, node))
            yield _pair_batch(*np.array(out, np.int64).reshape(-1, 2).T)

    return run


def verify(pairs: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. A node's pairs are dealt out over as many tasks as they need."""
    pairs = staged(pairs.select("a", "b").distinct(), "pairs")
    salts = F.ceil(F.count("*") / GROUP_PAIRS).cast("long")
    dealt = pairs.join(pairs.groupBy("a").agg(salts.alias("salts")), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    leads = dealt.select("a", "salt", F.lit(True).alias("lead"), F.col("a").alias("node")).distinct()
    need = staged(leads.unionByName(dealt.select("a", "salt", F.lit(False).alias("lead"), F.col("b").alias("node"))), "need")
    rows = texts.sets(need).select("a", "salt", "lead", "node", "elements")
    sorted_ = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("lead"))
    return sorted_.mapInArrow(_verified(percent), "a bigint, b bigint").distinct()


# --- buckets ---


def _possible(percent: int) -> Callable:
    """Of pairs with sizes and sketches: those that the bound doesn't exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for i, (na, nb, sa, sb) in enumerate(zip(*(rows.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                x, y = np.frombuffer(sa, U), np.frombuffer(sb, U)
                length = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, length) ^ folded(y, length)).sum())
                if max(apart, abs(na - nb)) <= (100 - percent) * (na + nb) // (100 + percent):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at)], ["a", "b"])

    return run


def possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    sides = [sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in ("a", "b")]
    full = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "sa", "sb")
    return full.mapInArrow(_possible(percent), "a bigint, b bigint")


class Bucket:
    """Nodes of a bucket by size, with their components and sketches."""

    def __init__(self, rows: list[tuple]):
        """rows: (id, node, root, n, sketch, ...)."""
        self.rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: (r[3], r[1]))
        self.nodes = np.array([r[1] for r in self.rows], np.int64)
        self.comps = np.unique(np.array([r[2] for r in self.rows], np.int64), return_inverse=True)[1]
        self.sizes = np.array([r[3] for r in self.rows], np.int64)
        words = [np.frombuffer(r[4], U) for r in self.rows]
        length = min(map(len, words))
        self.table = np.stack([folded(w, length) for w in words])

    def admissible(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of pairs of different components, both ways, in order of the first, and their least distances."""
        step = max(1, CHUNK // max(1, len(self.nodes) * self.table.shape[1] // 8))
        for i in range(0, len(self.nodes), step):
            a = np.arange(i, min(i + step, len(self.nodes)))
            # sizes are sorted: partners of a size stand together, before or after
            first = int(np.searchsorted(self.sizes, self.sizes[a[0]] * percent // 100, side="left"))
            last = int(np.searchsorted(self.sizes, self.sizes[a[-1]] * 100 // percent, side="right"))
            b = np.arange(first, last)
            x, y = np.nonzero(self.comps[a][:, None] != self.comps[b])
            x, y = a[x], b[y]
            apart = np.bitwise_count(self.table[x] ^ self.table[y]).sum(1, dtype=np.int64)
            ok = apart <= (100 - percent) * (self.sizes[x] + self.sizes[y]) // (100 + percent)
            yield x[ok], y[ok], apart[ok]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Bucket]]:
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for bid, bucket in groupby(rows, key=lambda r: r[0]):
        yield bid, Bucket(list(bucket))


def _crossing(percent: int) -> Callable:
    """Of each bucket (rows sorted by id): pairs of nodes of different components that size and sketch don't exclude.

    A bucket with more than DENSE such pairs for each node gives each node's nearest partner and, as a row with bid, its
    own id: it stays open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bid, own in _buckets(batches):
            found, nearest, n = [], [], 0
            for x, y, apart in own.admissible(percent):
                n += int((x < y).sum())
                if n <= DENSE * len(own.nodes):
                    found.append((x[x < y], y[x < y]))
                order = np.lexsort((apart, x))
                x, y = x[order], y[order]
                lead = np.ones(len(x), bool)
                lead[1:] = x[1:] != x[:-1]
                nearest.append((x[lead], y[lead]))
            if n > DENSE * len(own.nodes):
                found = nearest
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([bid], pa.int64())], ["a", "b", "bid"])
            for x, y in found:
                if len(x):
                    pairs = _pair_batch(own.nodes[x], own.nodes[y])
                    yield pa.RecordBatch.from_arrays([*pairs.columns, pa.nulls(len(x), pa.int64())], ["a", "b", "bid"])

    return run


def _settled(percent: int) -> Callable:
    """Of each bucket (rows sorted by id, with elements): links that join two of its components, and no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _buckets(batches):
            up = list(range(int(own.comps.max()) + 1))

            def top(c: int) -> int:
                while up[c] != c:
                    up[c] = up[up[c]]
                    c = up[c]
                return c

            links_ = []
            for x, y, apart in own.admissible(percent):
                for k in np.argsort(apart, kind="stable"):
                    i, j = int(x[k]), int(y[k])
                    a, b = top(int(own.comps[i])), top(int(own.comps[j]))
                    if i < j and a != b and similar(np.frombuffer(own.rows[i][5], U), np.frombuffer(own.rows[j][5], U), percent):
                        up[a] = b
                        links_.append((i, j))
            i, j = np.array(links_, np.int64).reshape(-1, 2).T
            yield _pair_batch(own.nodes[i], own.nodes[j])

    return run


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Pairs, smaller node first."""
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


# --- the operator ---


def _signed(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(member, names, sketches, shared), staged.

    member: doc_id, node, n. names: handle, node, hi, lo. sketches: node, n, sketch. shared: bid, node of all buckets.
    """
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = min(1 << 30, max(1, math.ceil(chars * SIGNATURES_PER_CHAR / BUCKET_SIGNATURES)))
    packed = rows.mapInArrow(_packed(width, percent, buckets), _PACKED)
    sorted_ = packed.repartition(min(buckets, PARTITIONS), "bucket").sortWithinPartitions("bucket", F.desc("hot"))
    found = staged(sorted_.mapInArrow(_unpacked, _FOUND), "signed", "kind")
    documents = found.where("kind = 'document'")
    firsts = documents.where("hi IS NOT NULL")
    node = firsts.groupBy("hi", "lo").agg(F.min("handle").alias("node"))
    names = staged(firsts.select("handle", "hi", "lo").join(node, ["hi", "lo"]).select("handle", "node", "hi", "lo"), "names")
    named = names.select("handle", "node")
    worded = documents.where("handle IS NOT NULL").select("doc_id", "handle", "n").join(named, "handle").select("doc_id", "node", "n")
    member = staged(worded.unionByName(documents.where("handle IS NULL").select("doc_id", F.col("handle").alias("node"), "n")), "nodes")
    once = found.where("kind = 'bucket'").select("bid", "part", "members").dropDuplicates(["bid", "part"])
    shared = once.select("bid", F.explode("members").alias("handle")).join(named, "handle").select("bid", "node").distinct()
    sketches = firsts.select(F.col("handle").alias("node"), "n", "sketch")
    return member, names, sketches, staged(shared, "shared")


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(membership, roots, names).

    membership: doc_id, node, n (set size; node is null for empty sets). roots: node, root of every node that is linked
    with another one; root is the smallest such node. names: node, hi, lo (a set's identity) of all nodes, repeated.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    member, names, sketches, shared = _signed(rows, width, percent)
    ids = names.where("handle = node").select("node", "hi", "lo")
    where = member.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    reps = staged(where.join(ids, "node"), "reps")
    texts = Texts(rows, reps, width)

    # first round: each node with the most central node of some of its buckets
    guide = shared.where(F.pmod(F.xxhash64("bid"), F.lit(GUIDE)) == 0)
    size = guide.groupBy("bid").agg(F.count("*").alias("size")).where("size > 1")
    weight = guide.join(size, "bid").groupBy("node").agg(F.sum("size").alias("weight"))
    heavy = guide.join(weight, "node")
    hub = heavy.groupBy("bid").agg(F.max(F.struct("weight", "node")).alias("h")).select("bid", F.col("h.node").alias("hub"))
    near = heavy.join(hub, "bid").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("common"))
    best = near.groupBy("node").agg(F.max(F.struct("common", "hub")).alias("h"))
    stars = best.select(F.col("h.hub").alias("a"), F.col("node").alias("b"))
    edges = staged(verify(possible(stars, sketches, percent), texts, percent), "links")
    roots = staged(components(edges), "roots")

    # second round: everything that the first one left apart
    full = _apart(shared, roots, sketches)
    proposed = staged(full.mapInArrow(_crossing(percent), "a bigint, b bigint, bid bigint"), "proposed")
    more = staged(verify(proposed.where("a IS NOT NULL"), texts, percent), "links")
    if not more.isEmpty():
        edges = edges.unionByName(more)
        roots = staged(components(edges), "roots")

    # third round: buckets that are still open
    open_ = proposed.where("bid IS NOT NULL").select("bid")
    if not open_.isEmpty():
        need = staged(_apart(shared.join(open_, "bid"), roots, sketches), "open")
        last = texts.sets(need).select("bid", "node", "root", "n", "sketch", "elements").repartition("bid").sortWithinPartitions("bid")
        more = staged(last.mapInArrow(_settled(percent), "a bigint, b bigint").distinct(), "links")
        if not more.isEmpty():
            roots = staged(components(edges.unionByName(more)), "roots")
    for done in (shared, sketches, reps, proposed):
        discard(docs.sparkSession, done)
    return member, roots, names


def _apart(shared: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """bid, node, root, n, sketch of the buckets with nodes of different components, a bucket's rows together."""
    part = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = part.groupBy("bid").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bid")
    full = part.join(apart, "bid").join(sketches, "node")
    return full.select("bid", "node", "root", "n", "sketch").repartition("bid").sortWithinPartitions("bid")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of docs."""
    member, of_node, _ = _components(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width, percent)
    return _placed(member, of_node)


def _placed(member: DataFrame, of_node: DataFrame) -> DataFrame:
    # rows without a word apart: as nulls of a join's key they would all meet in one task
    worded = member.where("node IS NOT NULL").join(of_node.drop("root"), "node")
    empty = member.where("node IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    both = worded.select("doc_id", "n", "component_id").unionByName(empty)
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The membership of links(), node, root and component_id of every node, and links()'s names."""
    member, roots, names = links(docs, width, percent)
    # classes are small against documents: one row for each set, then for each component
    ids = member.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"))
    named = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return member, named.select("node", "root").join(lowest, "root").select("node", "root", "component_id"), names


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one document of each group of linked ones; the smallest id stays, once.

    Of a group without any id, one row stays; rows without a word are in no group.
    """
    member, of_node, names = _components(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width, percent)
    of_node = staged(of_node, "components")
    found = _placed(member, of_node)
    keep = found.groupBy("doc_id", "component_id").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n"))
    keep = staged(keep.where("doc_id = component_id OR doc_id IS NULL"), "keep")
    # the ids that leave are fewer than those that stay; broadcast, they spare the texts a shuffle
    stays = F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")
    gone = staged(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(stays).where("NOT stays").select(F.col("doc_id").alias("_gone")), "gone")
    if gone.limit(BROADCAST_GONE + 1).count() <= BROADCAST_GONE:
        gone = F.broadcast(gone)
    kept = docs.where(F.col(doc_id).isNotNull()).join(gone, F.col(doc_id) == F.col("_gone"), "left_anti")
    named = kept
    if not keep.where("rows > 1 AND n > 0").isEmpty():
        # rows that repeat an id: of equal texts one stays
        named = kept.dropDuplicates([doc_id, text])
    if keep.where("doc_id IS NULL").isEmpty():
        return named
    return named.unionByName(_nameless(docs, of_node, names, doc_id, text, width))


def _nameless(docs: DataFrame, of_node: DataFrame, names: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Rows without an id that no row with one is linked to, one of each group."""
    rows = docs.where(F.col(doc_id).isNull()).select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("text"))
    nodes = rows.select("text").distinct().mapInArrow(_identified(width), "text string, hi bigint, lo bigint")
    ids = names.where("handle = node").select("hi", "lo", "node")
    groups = nodes.join(ids, ["hi", "lo"], "left").join(of_node, "node", "left").where("component_id IS NULL")
    found = rows.join(groups.select(F.col("text").alias("_t"), "node", "root"), F.col("text").eqNullSafe(F.col("_t")))
    first = F.row_number().over(Window.partitionBy("root").orderBy("text"))
    worded = found.where("node IS NOT NULL").withColumn("_f", first).where("_f = 1").select("_row.*")
    return found.where("node IS NULL").select("_row.*").unionByName(worded)


def _identified(width: int) -> Callable:
    """Texts to their sets' identities, null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            found = [identity(s) if len(s) else (None, None) for s in (shingle_set(t, width, hashes) for t in b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], ["text", "hi", "lo"])

    return run
