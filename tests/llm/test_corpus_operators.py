"""Mixing, toxicity, near duplicates, chat, language model, the pipeline: operators that look at whole tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import chat, language_model, mixing, near_duplicates, quality, toxicity

import corpus_pipeline


def test_water_filling_caps_and_shares_again():
    got = mixing.water_fill([10, 100, 0], [Fraction(3), Fraction(1), Fraction(2)], Fraction(165), Fraction(2))
    assert got == [20, 145, 0] and sum(got) == Fraction(165)


def mixed_docs(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "b", "b", None])) for i in range(200)]
    rows += [(500, "x y z " * 700, "b"), (7, None, "a"), (8, "", "c"), (9, "p q r", "é"), (9, "p q r", "é"), (None, "n n", "a")]
    return spark.createDataFrame([(*r, "other") for r in rows], "doc_id long, text string, source string, size string")


def test_mix_meets_targets_and_repeats_itself(spark):
    df = mixed_docs(spark)
    got = mixing.mix(df, block_tokens=64)[0].collect()
    assert len(got) == df.count() and all(0 <= r.taken <= 2 * r["size"] for r in got)
    sources = {r.source: (r.source_size, r.target) for r in got}
    whole = sum(n for n, _ in sources.values())
    assert sum(t for _, t in sources.values()) == pytest.approx(1.5 * whole)
    for s, (n, t) in sources.items():
        assert t <= 2 * n and sum(r.taken for r in got if r.source == s) == round(t)
    key = lambda rows: sorted((r.doc_id if r.doc_id is not None else -1, r.taken) for r in rows)
    assert key(mixing.mix(df.repartition(7), block_tokens=64)[0].collect()) == key(got)


def test_schedule_is_spread_out(spark):
    df = spark.createDataFrame([(i, "w " * 40, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    order = mixing.mix(df, weights=(2, 1), block_tokens=100)[1]
    slots = [r.s for r in order.join(df.select("doc_id", "source"), "doc_id").groupBy("slot").agg(F.first("source").alias("s")).orderBy("slot").collect()]
    share = slots.count("a") / len(slots)
    for n in (30, 60, 120):
        assert abs(slots[:n].count("a") - share * n) < 5
    assert mixing.mix(df.limit(0))[0].count() == 0


def enumerated(chain, e):
    """Marginals by all label sequences."""
    a, total, on = np.exp(chain.transitions), 0.0, np.zeros(len(e))
    for ys in itertools.product((0, 1), repeat=len(e)):
        w = math.exp(sum(x for x, y in zip(e, ys) if y)) * math.prod(a[p, q] for p, q in zip(ys, ys[1:]))
        total += w
        on += w * np.array(ys)
    return on / total


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    chain = toxicity.Chain({}, np.zeros((3, 0)), transitions=rng.normal(size=(2, 2)))
    parts = [rng.normal(size=n) for n in (3, 0, 6, 1, 0)]
    lengths = np.array([len(p) for p in parts])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    odds = chain.marginals(np.concatenate(parts), starts, lengths)[0]
    expected = np.concatenate([enumerated(chain, p) for p in parts if len(p)])
    assert odds / (1 + odds) == pytest.approx(expected)


def toxic_rows(n=300, seed=3):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        ws = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        if i % 5 == 0:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(["Vile,", "rotten"]))
        rows.append((i, " ".join(ws), int(i % 5 == 0)))
    return rows


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)


def test_toxicity_separates_held_out_texts(spark):
    rows = toxic_rows()
    chain = toxicity.train(labelled(spark, rows[:200]))
    extra = [(900, None), (901, ""), (902, "vile vile " * 5000), (903, "w1 w2 " * 200_000 + "vile rotten vile")]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t, _ in rows[200:]] + [(*x, 0, None) for x in extra], "doc_id long, text string, score int, spans string")
    got = {r.doc_id: r for r in toxicity.score(df, chain).collect()}
    assert all(got[i].predicted == y for i, _, y in rows[200:])
    assert got[900].score == got[901].score < 0.5 and got[902].predicted == 1 and len(got[903].spans) == 3
    i, text, _ = next(r for r in rows[200:] if r[2])
    assert {text[s.start : s.end].lower() for s in got[i].spans} == {"vile", "rotten"} & {w.strip(",").lower() for w in text.split()}
    assert toxicity.score(df.limit(0), chain).count() == 0
    # the same sample, stored in another way, gives the same chain
    again = toxicity.train(labelled(spark, rows[:200][::-1]).repartition(5))
    assert again.features.keys() == chain.features.keys() and again.calibration == pytest.approx(chain.calibration)


def test_scores_match_a_slow_version(spark):
    rows = toxic_rows(120, 8)
    chain = toxicity.train(labelled(spark, rows))
    place = chain.features

    def weight(word, k):
        return sum(chain.theta[k][place[f]] for f in toxicity.features_of(word) if f in place)

    def slow(text):
        ws = toxicity.tokens(text)
        e = [chain.bias + weight(w, 1) + (weight(ws[i - 1], 0) if i else 0) + (weight(ws[i + 1], 2) if i + 1 < len(ws) else 0) for i, w in enumerate(ws)]
        p = list(enumerated(chain, np.clip(e, -30, 30))) if ws else []
        rate = sum(p) / max(1, len(p)) * 100
        x = [1, math.log1p(sum(p)), max(p, default=0), math.log1p(rate), math.log1p(sum(v >= 0.5 for v in p))]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, chain.calibration))))

    texts = ["", "vile w1 rotten w2", "w1 w2 w3", "Rotten", *(" ".join(t.split()[:9]) for _, t, _ in rows[:30])]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chain).collect()
    assert all(r.score == pytest.approx(slow(texts[r.doc_id]), abs=1e-9) and r.predicted == (r.score >= 0.5) for r in got)


def test_feature_counts_and_calibration_match_a_slow_version(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_FEATURES", 50)
    rows = toxic_rows(60, 4)
    expected = Counter()
    for _, t, y in rows:
        expected.update((f, y) for f in {f for w in toxicity.tokens(t) for f in toxicity.features_of(w)})
    got = toxicity.feature_counts(labelled(spark, rows)).collect()
    assert {r.feature: (r.yes, r.no) for r in got} == {f: (expected[f, 1], expected[f, 0]) for f, _ in expected}
    rng = np.random.default_rng(6)
    x = np.column_stack([np.ones(80), rng.normal(size=80)])
    y = (rng.random(80) < 1 / (1 + np.exp(-x[:, 1]))).astype(float)
    w = toxicity._calibrated(x, y)
    p = 1 / (1 + np.exp(-x @ w))
    assert x.T @ (y - p) == pytest.approx([1e-6 * w[0], 1e-2 * w[1]], abs=1e-6)


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_one_class_gives_its_share(spark, labels):
    chain = toxicity.train(labelled(spark, [(i, "x", y) for i, y in enumerate(labels)]))
    score = chain.scores(chain.batch(["x y"])[2])[0]
    assert round(float(score)) == (1 if labels and labels[0] else 0)


def test_labels_are_cleaned(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    assert [(r.text, r.toxic) for r in toxicity.sample(docs, labels, F.lit(True)).collect()] == [("a", 1)]


def shingles(text, width):
    ws = (text or "").encode().lower().split()
    k = min(width, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if k else set()


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d if d is not None else -1, len(s), low.get(find(i), -1)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randint(0, edits)):
            ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(ws))
    return out


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for n in [1, 2, 5, 6, 7, 9, 13, 20, 40, 90, 200, 500] * 12:
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        most = int(15 * n / 100)
        drop = int(rng.integers(0, most + 1))
        add = max(0, min(int(rng.integers(0, most + 1)), int((n - drop) * 100 / 85 - n)))
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, add).astype(np.uint64))))
        a = np.unique(a)
        # equal sets are one node and need no signature
        if near_duplicates.similar(a, b, 85) and not np.array_equal(a, b):
            sig, of = near_duplicates.signatures([a, b], 85)
            assert set(sig[of == 0]) & set(sig[of == 1]), n


@pytest.mark.parametrize("hot", [near_duplicates.HOT, 2])
def test_packed_signatures_come_back(spark, hot, monkeypatch):
    # sizes of many schemes in one task, so that the sets' numbers don't rise
    monkeypatch.setattr(near_duplicates, "HOT", hot)
    rng = np.random.default_rng(9)
    sig = rng.integers(0, 2**63, 5000).astype(np.uint64)
    sig = np.concatenate((sig, sig[:3000], sig[:500], np.repeat(sig[:3], 70)))
    of = rng.permutation(np.arange(len(sig)) % 60_000).astype(np.uint16)
    for buckets in (1, 7):
        packs = list(near_duplicates._dealt(sig, of, 5 << 16, buckets))
        rows = sorted((r for b in packs for r in b.to_pylist()), key=lambda r: (r["bucket"], not r["hot"]))
        batch = near_duplicates._batch(near_duplicates._PACKED, len(rows), **{c: [r[c] for r in rows] for c in ("bucket", "hot", "base", "sigs", "of")})
        got, parts = Counter(), {}
        for b in near_duplicates._unpacked(iter([batch])):
            for r in b.to_pylist():
                parts.setdefault(r["bid"], []).extend(r["members"])
        got.update(tuple(sorted(m)) for m in parts.values())
        expected = {}
        for s, o in zip(sig.tolist(), of.tolist(), strict=True):
            expected.setdefault(s, []).append((5 << 16) + o)
        assert got == Counter(tuple(sorted(m)) for m in expected.values() if len(m) > 1)


def test_sketch_distance_never_exceeds_the_real_one():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64))
        b = np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64))
        x, y = near_duplicates.sketch(a), near_duplicates.sketch(b)
        n = min(len(x), len(y))
        least = int(np.bitwise_count(near_duplicates.folded(x, n) ^ near_duplicates.folded(y, n)).sum())
        assert least <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("dense", [near_duplicates.DENSE, 0])
def test_join_matches_brute_force(spark, dense, monkeypatch):
    monkeypatch.setattr(near_duplicates, "DENSE", dense)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "One", "a b", "a b c d", "A b  c d"]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    for n in (12, 30, 80, 150):
        base = [rng.choice(vocabulary) for _ in range(n)]
        texts += copies(rng, base, 25, max(1, n // 20))
        texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(n // 4)]) for _ in range(6)]
    texts += [texts[20]] * 10
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, "z " * 9), (5, "z " * 9)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, root int")
    got = near_duplicates.join(df).collect()
    key = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got)
    assert key == brute_components(rows, 4, 85)


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base), (1, base), (2, base + " end"), (4, "other text here"), (5, None), (6, ""), (4, "other text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_duplicates.one_of_each(df).collect()) == [1, 4, 5, 6]
    assert near_duplicates.one_of_each(df.limit(0)).count() == 0


def test_rows_without_an_id_link_and_leave(spark):
    rng = random.Random(19)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(3)]
    text = lambda k, end="": " ".join(base[k]) + end
    # 5 and a near copy without id; 7 and 9 linked by a row without id only; copies without any id; nothing
    seven, nine = " ".join(base[1][8:]), " ".join(base[1][:-8])
    rows = [(5, text(0)), (None, text(0, " end")), (7, seven), (None, text(1)), (9, nine), (None, text(2)), (None, text(2)), (None, text(2, " end")), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, c string")
    got = near_duplicates.join(df).collect()
    key = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got)
    assert key == brute_components(rows, 4, 85) and (9, len(shingles(nine, 4)), 7) in key
    kept = near_duplicates.one_of_each(df, width=4, percent=85)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [5, 7]
    nameless = [r.text for r in got if r.doc_id is None]
    assert sorted(t or "" for t in nameless)[:2] == ["", ""] and len(nameless) == 3


def rendered(template, messages):
    return "".join(p for p, _ in chat.compiled(template)(iter(messages)))


def test_template_language():
    m = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]
    assert rendered("{% for m in messages %}{{ loop.index0 }}{% if loop.first %}F{% elif loop.last %}L{% else %}M{% endif %}{{ m.text | upper }} {% endfor %}", m) == "0FHI 1LYO "
    assert rendered("{% set a = 'x' + 1 %}{{ a + '\\n' }}{% if not (a == 'x1') or 'u' in 'user' and true %}y{% endif %}", []) == "x1\ny"
    for bad in ("{% for m in range %}{% endfor %}", "{{ m.__class__ }}", "{{ open('x') }}", "{% if a %}", "{{ a | eval }}", "{% while %}", "{{ 'a }}", "{{ a b }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


def test_folding_keeps_the_meaning_and_joins_text():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{{ x + 'e' + 'f' }}"))
    assert tree == ("block", ("out", ("const", "abcd")), ("out", ("+", ("name", "x"), ("const", "ef"))))


def test_escaping_is_reversible():
    rng = random.Random(6)
    parts = ["<|", "im_end|>", "\n", "\\", "</s>", "<s>", "[INST]", "[/INST]", "n", "|", "<", "é", "<|im_end|>\n", "/"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_conversations_read_back(spark):
    rows = [(1, 0, "user", "hi <|im_end|>\n"), (1, 1, "assistant", "a\\b"), (1, 1, "assistant", "a\\b"), (2, None, None, None), (None, 0, "assistant", ""), (1, 2, "ro\nle", "x"), (1, 3, "assistant", "[INST]")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    by = {1: [r for r in rows if r[0] == 1], 2: [(2, None, "", "")], None: [(None, 0, "assistant", "")]}
    by[1].sort(key=lambda r: (r[1], r[2], r[3]))
    for cid, own in by.items():
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        whole = "".join(f"{r[2]}\n{r[3]}\n" for r in own)
        assert got[cid].n_turns == len(own) and got[cid].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[cid].loss_chars, got[cid].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    full = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert all(len(full[c].formatted) == got[c].formatted_chars for c in full)
    spans = full[1].loss_spans
    assert chat.unescape("".join(full[1].formatted[s.start : s.end] for s in spans)) == "a\\ba\\b[INST]"
    assert chat.digests(df.limit(0)).count() == 0


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(3)
    groups = np.arange(41) % 4
    m = np.where(groups[:, None] == (groups[None, :] + 1) % 4, rng.integers(5, 30, (41, 41)), rng.integers(0, 2, (41, 41)))

    def likelihood(of):
        t = np.zeros((8, 8))
        np.add.at(t, (of[:, None], of[None, :]), m)
        f = language_model._xlogx
        return f(t).sum() - f(t.sum(0)).sum() - f(t.sum(1)).sum()

    of = language_model.exchange(m, 1, 8)
    start = np.concatenate(([0], 1 + np.arange(40) % 7))
    assert likelihood(of) > likelihood(start) and of[0] == 0 and (of[1:] > 0).all()
    # no single move raises it
    for u in range(1, 41):
        for c in range(1, 8):
            other = of.copy()
            other[u] = c
            assert likelihood(other) <= likelihood(of) + 1e-6


def test_words_are_cut_as_bytes_are_split():
    import pyarrow as pa

    rng = random.Random(5)
    parts = ["a", "B", " ", "\n", "\x0b", "\x1c", "é", "É", "字", "\u00a0", "\u2003", "ZZ", "\t "]
    texts = ["", None, " ", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)), "x " * 3000]
    seen = {}
    for chunk in (10, 10**6):
        language_model.CHUNK_BYTES, old = chunk, language_model.CHUNK_BYTES
        got = []
        for tokens, n, i in language_model.sequences(pa.array(texts).slice(1)):
            assert tokens[0] == language_model.END and i == len(got)
            at = 1
            for k in n:
                got.append(tokens[at : at + k].tolist())
                assert tokens[at + k] == language_model.END
                at += k + 1
        language_model.CHUNK_BYTES = old
        assert len(got) == len(texts) - 1
        for t, hs in zip(texts[1:], got, strict=True):
            ws = (t or "").encode().lower().split()
            assert len(hs) == len(ws) and all(seen.setdefault(h, w) == w for h, w in zip(hs, ws, strict=True))
    assert len(set(seen.values())) == len(seen)
    assert language_model.hashes_of([b"", *seen.values()]).tolist() == [1, *seen]


def lm_split(t):
    return [*(t or "").encode().lower().split(), b""]


def lm_rows():
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["the", "The", "of", "x", "rare%d" % rng.randrange(400)]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    return [*enumerate(texts), (200, None), (201, ""), (202, "é É\x0bz"), (202, "é É\x0bz"), (None, "the of"), (203, "the unseen of " * 2000)]


@pytest.mark.parametrize("settings", [{}, {"units": 2}, {"units": 5, "class_words": 9}, {"cluster_count": 10**6}, {"classes": 2}])
def test_language_model_matches_brute_force(spark, settings, monkeypatch):
    monkeypatch.setattr(language_model, "PART_WORDS", 7)
    monkeypatch.setattr(language_model, "HELD_NEIGHBOURS", 300)
    rows = lm_rows()
    df = spark.createDataFrame([(*r, "c", 1, "k") for r in rows], "doc_id long, text string, c string, word int, kind string").repartition(3)
    out = language_model.held_out(F.col("doc_id"))
    model, counts = language_model.learn(df.where(~out).select("text"), **({"units": 20, "classes": 6, "cluster_count": 3} | settings))
    got = language_model.score(df, model, counts).collect()
    train_texts = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    train = Counter(w for t in train_texts for w in lm_split(t))
    n, v = sum(train.values()), len(train)
    assert len(got) == len(rows) and (model.n, model.v) == (n, v)
    # class counts are exact, over all words and bigrams
    kinds = list({w for _, t in rows for w in lm_split(t)})
    of = dict(zip(kinds, model.classes(kinds).tolist(), strict=True))
    size = len(model.class_tokens)
    tokens = [sum(c for w, c in train.items() if of[w] == k) for k in range(size)]
    words = [sum(of[w] == k for w in train) for k in range(size)]
    assert tokens == model.class_tokens.tolist() and words == model.class_words.tolist()
    pairs = Counter((of[a], of[b]) for t in train_texts for a, b in itertools.pairwise([b"", *lm_split(t)]))
    share = [(tokens[k] + 1) / (n + size) for k in range(size)]
    total = [sum(pairs[j, k] for k in range(size)) for j in range(size)]
    moves = [[math.log10((pairs[j, k] + 5 * share[k]) / (total[j] + 5)) for k in range(size)] for j in range(size)]
    assert (10**model.transition).sum(1) == pytest.approx(1) and np.allclose(model.transition, moves)
    expected = Counter()
    for d, t in rows:
        ws = lm_split(t)
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        score = sum(moves[of[a]][of[b]] + math.log10((train[b] + 0.5) / (tokens[of[b]] + 0.5 * (words[of[b]] + 1))) for a, b in itertools.pairwise([b"", *ws]))
        expected[d, len(ws), sum(train[w] > 0 for w in ws), round(base, 5), round(score, 5)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in got) == expected


def test_most_frequent_words_with_many_ties(spark):
    rng = np.random.default_rng(4)
    word = np.unique(rng.integers(-(2**63), 2**63 - 1, 3000))
    c = np.where(np.isin(np.arange(len(word)), rng.choice(len(word), 40, False)), 500 + np.arange(len(word)), 7)
    counts = spark.createDataFrame(list(zip(word.tolist(), c.tolist())), "word long, c long")
    for n in (10, 40, 41, 500, 5000):
        got, times = language_model.most_frequent(counts, n)
        order = np.lexsort((word, -c))[:n]
        assert got.view(np.int64).tolist() == word[order].tolist() and times.tolist() == c[order].tolist()


def test_words_beyond_the_units_choose_their_own_class(spark):
    # xing words follow "a" and precede "b", yxing words the other way round
    rng = random.Random(31)
    xs, ys = ([f"{p}{i}ing" for i in range(40)] for p in "xy")
    pairs = lambda: [w for _ in range(30) for w in rng.choice((("a", rng.choice(xs), "b"), ("c", rng.choice(ys), "d")))]
    texts = [" ".join(pairs()) for _ in range(150)] + ["", None, "once"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    model, _ = language_model.learn(df, units=24, classes=9)
    k = dict(zip(xs + ys, model.classes([w.encode() for w in xs + ys]).tolist(), strict=True))
    assert not {k[w] for w in xs} & {k[w] for w in ys} and language_model.REST_CLASS not in k.values()
    assert model.classes([b"once", b"never", b""]).tolist() == [1, 1, 0]


def test_language_model_without_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model, counts = language_model.learn(none.select("text"), units=4, classes=3)
    got = language_model.score(spark.createDataFrame([(1, "a b")], none.schema), model, counts).collect()
    assert got[0].n_known == 0 and got[0].train_tokens == 0 and math.isfinite(got[0].score)
    assert language_model.score(none, model, counts).count() == 0


def test_pipeline_decisions_take_effect(spark, tmp_path):
    rng = random.Random(21)
    words = [f"word{i}" for i in range(300)]
    prose = lambda n: "".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + ".\n" for _ in range(n)).strip()
    good = [prose(8) for _ in range(6)]
    item = " ".join(rng.choice(words) for _ in range(30))
    texts = {0: good[0], 1: good[1], 2: good[0], 3: good[1] + "\nOne more line with words in it.", 4: "| | |\n" * 9, 5: good[2] + "\n" + item.capitalize() + ".", 6: good[3] + "\nWrite to someone at me@mail.example.com today, please.", 7: None, 8: good[4]}
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    expected = [{0, 1, 2, 3, 5, 6, 8}, {0, 1, 5, 6, 8}, {0, 1, 6, 8}, {0, 1, 6, 8}]
    for (_, stage), ids in zip(corpus_pipeline.STAGES, expected):
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in kept.select("doc_id").collect()} == ids
    assert "[EMAIL]" in kept.where("doc_id = 6").first().text
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == expected[-1] and all(r.taken <= 2 * r["size"] for r in final)


def brute_line_fails(line):
    import regex

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
    if not words:
        return False
    gone = lambda pattern: len(line) - len(re.sub(pattern, "", line))
    unquoted = re.sub("«[^«»]*»|»[^«»]*«|‹[^‹›]*›|›[^‹›]*‹", "", line)
    marks = len(re.findall("[|»›·•]", unquoted))
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[|»›·•]", " ", line)) if w]
    menu = marks >= 3 and marks * 8 > len(own)
    phrases = gone("(?i)" + "|".join(quality.BOILERPLATE))
    noise = max(gone(r"[#*$%&|<>{}~^\\]"), gone("!!")) * 100 > len(line) * 10
    open_ = not regex.search(r"\p{P}[\x20\x09-\x0D]*$", line) and len(words) < 4
    return menu or phrases and phrases * 100 >= len(line) * 10 or noise or open_


def brute_clean(text):
    """The text without its failing lines, or None."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if twice[w] > 1 for j in range(5)}
    out = "\n".join(x for x in text.split("\n") if not brute_line_fails(x))
    bad = len(words) < 10 or 100 * len(repeated) > 20 * len(words) or 100 * len(out) < 50 * len(text)
    return None if bad else out


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(77)
    words = [f"word{i}" for i in range(500)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    bases = ["\n".join(line(rng.randint(6, 30)) for _ in range(rng.randint(1, 9))) for _ in range(25)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 12, 30)]
    spoil = ["Home | News | Sport | Contact", "Read more", "Click here to accept cookies.", "$$$ %%% ###", "WOW!! NOW!!", "short", f"{line(40)} » {line(9)} » x » y", "« a » « b » « c » " + line(6)]
    texts = [None, "", " \n ", "too short.", "same five words here now " * 9]
    for k, b in enumerate(bases):
        texts += [b, b + "\n" + rng.choice(spoil), b if k % 3 else b.lower()]
        if k % 4 == 0:
            texts.append(b + "\n" + rng.choice(items).capitalize() + " and so on it goes.")
        if k % 5 == 0:
            texts.append(line(12) + f"\nWrite to some{k}@mail.example.com or me@x.org.\n" + line(15))
        if k % 6 == 0:
            texts.append("\n".join(rng.choice(spoil) for _ in range(6)) + "\n" + line(5))
        ws = b.split(" ")
        ws[len(ws) // 2] = "changed"
        texts.append(" ".join(ws))
    rng.shuffle(texts)
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", "b", None]), 0, "x") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(d, t, source) for d, raw, _, source, *_ in rows if (t := brute_clean(raw)) is not None]
    first = {(d, t): low for (d, t, _), (_, _, low) in zip(kept, sorted(brute_components([(d, t) for d, t, _ in kept], 5, 80)), strict=True)}
    kept = [(d, t, s) for d, t, s in kept if first[d, t] == d]
    def holds(t):
        own = (t or "").lower().split()
        for item in items:
            wanted = shingles(item, 5)
            k = len(next(iter(wanted)))
            have = {tuple(w.encode() for w in own[i : i + k]) for i in range(len(own) - k + 1)}
            if len(wanted & have) >= 0.8 * len(wanted):
                return True
        return False

    kept = [(d, re.sub(r"[\w.]+@[\w.]+\w", "[EMAIL]", t), s) for d, t, s in kept if not holds(t)]
    sizes = {d: len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]) for d, t, _ in kept}
    by = Counter()
    for d, _, s in kept:
        by[s] += sizes[d]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    left, open_, target = 1.5 * sum(by.values()), dict(zip(order, (3, 1, 2), strict=False)), {}
    while open_:
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) > 2 * by[s]]
        for s in over or list(open_):
            target[s] = 2 * by[s] if over else left * open_[s] / sum(open_.values())
        if not over:
            break
        for s in over:
            left -= target[s]
            del open_[s]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == sorted((d, sizes[d], by[s], round(target[s], 6)) for d, _, s in kept)
    assert 20 < len(kept) < len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    for s in by:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 1
