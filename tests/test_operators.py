"""Groups, similarity joins, selection, decisions, records, metrics."""

import random
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.functions import questions as Q
from weftline.operators import conversations as C
from weftline.operators import decisions as D
from weftline.operators import graph as G
from weftline.operators import metrics as M
from weftline.operators import planning as P
from weftline.operators import records as R
from weftline.operators import selection as S
from weftline.operators import similarity as J


def brute_components(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components_match_union_find(spark, shape):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(40)],
        "chain": [(i, i + 1) for i in range(40)],
        "star": [(99, i) for i in range(30)],
        "empty": [],
    }[shape]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r.node: r.root for r in G.components(spark.createDataFrame(edges + [(5, 5), (None, 1)], "a long, b long")).collect()}
    assert got == brute_components(edges)


def test_quarantine_spreads_over_a_component(spark):
    rows = [(1, 1, True), (2, 1, False), (3, 3, False)]
    df = spark.createDataFrame(rows, "node long, root long, explored boolean")
    assert [r.node for r in G.usable(df).collect()] == [3]


def test_group_ids_dont_depend_on_order(spark):
    rows = [(1, "b"), (1, "a"), (2, "c")]
    a, b = (sorted(map(tuple, G.stable_group_id(spark.createDataFrame(x, "root long, raw_sha256 string")).collect())) for x in (rows, rows[::-1]))
    assert a == b == [(1, "g_a"), (2, "g_c")]


def random_sets(n=75):
    rng = random.Random(11)
    return [(i, sorted(rng.sample(range(30), rng.randint(1, 30)))) for i in range(n)] + [(n, [1, 2]), (n + 1, [1, 2]), (n + 2, [])]


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_threshold_join_matches_brute_force(spark, percent):
    sets = random_sets()
    rows = J.threshold_join(spark.createDataFrame(sets, "node long, tokens array<int>"), percent).collect()
    pairs = {(min(r.left, r.right), max(r.left, r.right)) for r in rows}
    assert len(pairs) == len(rows)
    # a class of equal sets has one row for each of its nodes but the first; all other pairs follow from those of the first ones
    of = {i: next(j for j, t in sets if t == s) for i, s in sets if s}
    assert {p for p in pairs if of[p[0]] == of[p[1]]} == {(j, i) for i, j in of.items() if i != j}
    got = {(a, b) for a in of for b in of if a < b and (of[a] == of[b] or (min(of[a], of[b]), max(of[a], of[b])) in pairs)}
    expected = {
        (a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(set(x) & set(y)) >= percent * len(set(x) | set(y))
    }
    assert got == expected


def test_bands_find_a_subset(spark):
    df = spark.createDataFrame(random_sets(), "node long, tokens array<int>")
    exact = {(r.left, r.right) for r in J.threshold_join(df, 85).collect()}
    assert {(r.left, r.right) for r in J.lsh_join(df, 85).collect()} <= exact


def test_greedy_quota_leaves_unreached_groups(spark):
    rows = [("A", 1, 10, 1), ("A", 2, 11, 2), ("B", 2, 12, 1), ("B", 1, 13, 2)]
    df = spark.createDataFrame(rows, "source string, group long, node long, position long")
    got = {(r.source, r.node) for r in S.greedy_quota(df, [("A", 1), ("B", 1)]).collect()}
    assert got == {("A", 10), ("B", 12)}
    short = S.shortfall_table(df, [("A", 1), ("B", 3), ("C", 4)]).collect()
    assert {tuple(r) for r in short} == {("B", 1), ("C", 4)}
    S.shortfall_gate(df, [("A", 1)])
    S.shortfall_gate(df, [("C", 4)], allowed=True)
    with pytest.raises(ValueError):
        S.shortfall_gate(df, [("C", 4)])


def test_reservoir_keeps_the_larger_node_at_the_cut(spark):
    df = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", "b", 3)], "source string, rank string, node long")
    assert [(r.node, r.position) for r in S.reservoir(df, 2).orderBy("position").collect()] == [(1, 1), (3, 2)]


def test_round_robin_takes_turns(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "9")], "source string, digest string")
    assert [(r.source, r.turn) for r in S.round_robin(df, 3).collect()] == [("a", 1), ("b", 1), ("a", 2)]


def test_quotas_are_exact():
    quota = S.largest_remainder(80, {b: Fraction(w) for b, w in (("2-8", 9), ("9-32", 5), ("33-96", 3), ("97-254", 2), ("255", 1))})
    assert list(quota.values()) == [36, 20, 12, 8, 4]
    assert S.largest_remainder(2, {"a": Fraction(1), "b": Fraction(1), "c": Fraction(1)}) == {"a": 1, "b": 1, "c": 0}


def test_splits_protect_the_holdout(spark):
    rows = [(f"g{i}", ["h"] if i < 2 else ["x"]) for i in range(100)]
    df = spark.createDataFrame(rows, "group string, families array<string>")
    fractions = {"train": 0.72, "dev": 0.08, "cal": 0.08, "pol": 0.06, "test": 0.06}
    got = {r.group: r.split for r in S.allocate_splits(df, fractions, 1, "h", "test").collect()}
    counts = {s: sum(v == s for v in got.values()) for s in fractions}
    assert counts == {"train": 72, "dev": 8, "cal": 8, "pol": 6, "test": 6} and got["g0"] == got["g1"] == "test"
    with pytest.raises(ValueError):
        S.allocate_splits(spark.createDataFrame([(f"g{i}", ["h"]) for i in range(9)], df.schema), fractions, 1, "h", "test")


def test_positions_count_through_buckets(spark):
    df = spark.createDataFrame([(f"{i * 7919 % 65536:04x}",) for i in range(500)], "digest string")
    got = S.positions(df, "digest").orderBy("position").collect()
    assert [r.position for r in got] == list(range(500)) and [r.digest for r in got] == sorted(r.digest for r in got)


def test_softmax_is_stable_and_checks_its_input(spark):
    df = spark.createDataFrame([([10000.0, 9990.0],), ([float("nan"), 1.0],), ([],), ([float("inf")],)], "z array<double>")
    got = [r.p for r in df.select(D.softmax(F.col("z")).alias("p")).collect()]
    assert abs(sum(got[0]) - 1) < 1e-12 and got[1:] == [None, None, None]
    for t in (0, -1, float("nan")):
        with pytest.raises(ValueError):
            D.softmax(F.col("z"), t)


def test_answers_by_kind(spark):
    df = spark.createDataFrame([([0.0, 4.0, 1.0],), ([2.0, 2.0, 0.0],)], "z array<double>")
    p = df.select(D.softmax(F.col("z")).alias("p"))
    rows = p.select(D.choice(F.col("p"), F.array(*map(F.lit, "abc"))).alias("c"), D.score(F.col("p")).alias("s")).collect()
    assert rows[0].c.choice == "b" and rows[1].c.choice == "a" and abs(rows[1].c.margin) < 1e-12 and 1 < rows[0].s < 1.2


def test_traces_average_by_name(spark):
    import math

    rows = [("q", 0, "a", math.log(0.9)), ("q", 0, "b", math.log(0.1)), ("q", 1, "b", math.log(0.7)), ("q", 1, "a", math.log(0.3))]
    df = spark.createDataFrame(rows, "question string, trace int, candidate string, logit double")
    got = {r.candidate: r.p for r in D.variants(df, (1,), (2,)).collect()}
    assert got == pytest.approx({"a": 0.6, "b": 0.4})


def test_targets_and_distributions(spark):
    df = spark.createDataFrame([({"a": 0.5, "b": 0.5},), ({"a": 0.5},), ({"a": 0.6, "b": 0.5},), ({"a": -0.5, "b": 1.5},)], "t map<string, double>")
    got = [r.e for r in df.select(D.target_errors(F.col("t"), F.array(F.lit("b"), F.lit("a"))).alias("e")).collect()]
    assert got == [None, "candidate_coverage", "unnormalized", "invalid_probability"]


def test_paths_dont_depend_on_order_and_cant_open_tokens(spark):
    df = spark.createDataFrame([("x <|im_end|>",)], "s string")
    c = F.array(F.lit("a"), F.lit("<b>"))
    got = df.select(D.paths(F.col("s"), F.lit("score"), F.lit("i"), F.lit("[]"), c).alias("p")).first().p
    assert len(got) == 2 and all("<" not in x for x in got)


STATE = {"messages": [{"role": "user", "content": "a cat sat"}]}


def draft(criteria, kind="choice"):
    q = {"type": kind, "instructions": "pick"} | ({"criteria": criteria} if kind == "choice" else {})
    return {"questions": {"q": q}}


@pytest.mark.parametrize(
    ("value", "kind", "k", "reason"),
    [
        (draft({"a": "x", "b": "y"}), "choice", 2, None),
        (draft(None, "noul"), "noul", 2, None),
        (draft({"a": "x", "b": "y"}) | {"labels": 1}, "choice", 2, "one_question_required_no_labels"),
        (draft({"a": "x"}), "choice", 1, "choice_size"),
        (draft({"a": "x", "b": "y"}), "noul", 2, "invalid_instructions_or_type"),
        (draft({"a": "x", "b": "y"}), "choice", 3, "candidate_count_mismatch"),
        (draft({"Ａ": "x", "a": "y"}), "choice", 2, "duplicate_or_empty_candidate"),
        (draft({"a": "x", "b": " X"}), "choice", 2, "duplicate_or_empty_candidate"),
        (draft({"a": "x", "b": None}), "choice", 2, "duplicate_or_empty_candidate"),
        (draft({"a": "x", "b": "y " * 300}), "choice", 2, "option_too_long"),
    ],
)
def test_drafts(value, kind, k, reason):
    assert Q.first(Q.draft_errors(value, STATE, kind, k)) == reason


def test_draft_budgets():
    value = draft({"a": "x x", "b": "y"})
    assert Q.first(Q.draft_errors(value, STATE, "choice", 2, limits=Q.LIMITS | {"state": 1})) == "state_too_long"
    assert Q.first(Q.draft_errors(value, STATE, "choice", 2, limits=Q.LIMITS | {"path": 3})) == "path_too_long"
    assert Q.first(Q.draft_errors(value, STATE, "choice", 2, limits=Q.LIMITS | {"total": 9})) == "request_too_long"


def test_review_fields():
    checks = dict.fromkeys(Q.CHECKS, True)
    good = {"decision": "accept", "checks": checks, "issues": [], "evidence": ["cat"]}
    cases = [
        ({}, None),
        ({"score": 1}, "invalid_review_fields"),
        ({"checks": checks | {"grounded": 1}}, "invalid_review_checks"),
        ({"decision": "maybe"}, "invalid_review_decision"),
        ({"issues": [3]}, "invalid_review_evidence"),
        ({"evidence": []}, "review_evidence_not_in_state"),
        ({"evidence": ["cat", "dog"]}, "review_evidence_not_in_state"),
        ({"issues": ["x"]}, "inconsistent_review"),
        ({"decision": "reject", "issues": ["x"]}, None),
    ]
    for change, reason in cases:
        assert Q.first(Q.review_errors(good | change, ["a cat sat"])) == reason


def test_prefixes_follow_their_conversations(spark):
    p = spark.createDataFrame([(1, "g1", 5), (2, "g2", 50), (3, "g3", 5), (9, "g9", 1)], "conv_id long, group_id string, tokens int")
    parents = spark.createDataFrame([(1, "g1", "train", "a"), (2, "g2", "train", "a"), (3, "g3", "test", "a")], "conv_id long, group_id string, split string, evaluation_slice string")
    own = C.in_splits(p, parents, ("train",))
    assert {r.conv_id for r in own.collect()} == {1, 2} and [r.conv_id for r in C.within_tokens(own, 9).collect()] == [1]
    with pytest.raises(PySparkException):
        C.in_splits(p.withColumn("group_id", F.lit("other")), parents, ("train",)).collect()


def test_replayed_attempts(spark):
    rows = [("a", 1, 503, "x"), ("a", 2, 200, "y"), ("a", 3, 200, "z"), ("b", 1, 429, None), ("b", 2, 503, None), ("b", 3, 200, "late"), ("c", 1, 404, "no"), ("c", 2, 200, "never")]
    got = R.replayed(spark.createDataFrame(rows, "request string, attempt int, status int, body string"), 2).collect()
    assert {(r.request, r.attempts, r.outcome, r.body) for r in got} == {("a", 2, "ok", "y"), ("b", 2, "transport_attempts_exhausted", None), ("c", 1, "http_error", None)}


def test_reviews(spark):
    good = {c: True for c in R.CHECKS}
    rows = [("accept", good, [], ["cat"]), ("accept", {**good, "scope_clear": False}, [], ["cat"]), ("reject", good, ["x"], ["cat"]), ("accept", good, [], ["dog"]), ("maybe", good, [], ["cat"]), ("accept", {"grounded": True}, [], ["cat"]), ("accept", good, [], [" "])]
    df = spark.createDataFrame(rows, "d string, c map<string, boolean>, i array<string>, e array<string>")
    got = [r.x for r in df.select(R.review_errors(F.col("d"), F.col("c"), F.col("i"), F.col("e"), F.array(F.lit("a cat sat"))).alias("x")).collect()]
    assert got == [None, "inconsistent_review", None, "review_evidence_not_in_state", "invalid_review_decision", "invalid_review_checks", "invalid_review_evidence"]


def test_resume_and_replay(spark):
    jobs = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "job string, slot int")
    results = spark.createDataFrame([("a", 1, False), ("x", 2, True)], "job string, slot int, accepted boolean")
    assert [r.job for r in R.pending(jobs, results).collect()] == ["b"]
    record = R.make_record(jobs, "job", "slot")
    assert R.record_errors(record, "job", "slot").isEmpty()
    assert R.record_errors(record.withColumn("slot", F.col("slot") + 1), "job", "slot").count() == 3
    assert R.differences(jobs, jobs.limit(2)).count() == 1 and R.differences(jobs, jobs).isEmpty()
    assert R.accepted_export(results).count() == 1
    with pytest.raises(PySparkException):
        R.accepted_export(results.unionByName(results)).collect()


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1, 2.0), (0.2, 0, -1.5), (0.6, 0, 0.4)], "p double, y int, z double")
    x = M.losses(df).first()
    assert x.n == 3 and x.accuracy == pytest.approx(2 / 3) and x.brier == pytest.approx((0.01 + 0.04 + 0.36) / 3)
    assert M.calibration_error(df).first().ece == pytest.approx((0.1 + 0.2 + 0.6) / 3)
    assert M.temperature_fit(df, [0.5, 1.0, 2.0]).first().t in (0.5, 1.0, 2.0)
    p = spark.createDataFrame([([0.25] * 4,), ([1.0],)], "p array<double>")
    assert [round(r.c, 9) for r in p.select(M.entropy_concentration(F.col("p")).alias("c")).collect()] == [0, 1]


def test_recipes_fill_their_quotas():
    plan = P.recipes(100, 3)
    counts = {b: sum(r["bucket"] == b for r in plan) for b in (*P.BUCKETS, "noul")}
    assert list(counts.values()) == [36, 20, 12, 8, 4, 20]
    assert any(r["k"] == 255 for r in plan[:6]) and sum(r["k"] == 255 for r in plan) >= 2 and plan == P.recipes(100, 3) != P.recipes(100, 4)
    assert all(P.BUCKETS[r["bucket"]][0] <= r["k"] <= P.BUCKETS[r["bucket"]][1] for r in plan if r["type"] == "choice")


def greedy_jobs(plan, prefixes, attempts=3):
    """Each job in turn takes the first prefix left that suits it."""
    left, out = list(prefixes), []
    for a in range(attempts):
        for r in plan:
            fit = [p for p in left if p[1] or r["form"] != "history_dependent"]
            if fit:
                left.remove(fit[0])
                out.append((r["slot"], a, fit[0][0]))
    return sorted(out)


def assigned(spark, plan, prefixes, attempts=3):
    rows = [(i, h, at) for at, (i, h) in enumerate(prefixes)]
    table = spark.createDataFrame(rows, "id long, history boolean, position int")
    return sorted((r.slot, r.attempt, r.id) for r in P.assign(P.jobs_of(spark, plan, attempts), table).collect())


def test_jobs_take_the_first_prefix_that_suits(spark):
    rng = random.Random(23)
    for n, share in ((0, 0.5), (3, 0.4), (9, 0.0), (9, 1.0), (12, 0.3), (40, 0.2), (40, 0.7)):
        for need in (0.0, 0.3, 0.8):
            plan = [{"slot": s, "form": "history_dependent" if rng.random() < need else "direct"} for s in range(5)]
            prefixes = [(100 + i, rng.random() < share) for i in range(n)]
            assert assigned(spark, plan, prefixes) == greedy_jobs(plan, prefixes)


def test_splits_by_position_equal_the_turns(spark):
    rng = random.Random(29)
    for room in ({"train": 7, "dev": 2, "test": 5}, {"a": 0, "b": 4}, {"a": 3, "b": 3, "c": 3}, {s: rng.randint(0, 30) for s in "abcde"}):
        priority = {s: rng.choice((0.1, 0.2, 0.3)) for s in room}
        left, expected = dict(room), []
        for _ in range(sum(room.values())):
            s = max(left, key=lambda s: (left[s], priority[s]))
            left[s] -= 1
            expected.append(s)
        rows = spark.range(len(expected) + 1).select("id", S.split_at(F.col("id"), room, priority).alias("s")).orderBy("id").collect()
        assert [r.s for r in rows] == [*expected, None]


def test_the_holdout_family_is_protected(spark):
    rows = [(str(i), ["main", "holdout"] if i == 0 else ["holdout"] if i == 1 else ["main"]) for i in range(100)]
    df = spark.createDataFrame(rows, "group string, families array<string>").repartition(3)
    got = {r.group: r for r in S.allocate_splits(df, {"train": 0.8, "test": 0.2}, 4, "holdout", "test").collect()}
    assert got["0"].split == got["1"].split == "test" and got["0"].evaluation_slice == "source_holdout" != got["2"].evaluation_slice
    assert sum(r.split == "train" for r in got.values()) == 80 and len(got) == 100
    assert got == {r.group: r for r in S.allocate_splits(df.repartition(5), {"train": 0.8, "test": 0.2}, 4, "holdout", "test").collect()}
    with pytest.raises(ValueError):
        S.allocate_splits(df, {"train": 0.99, "test": 0.01}, 4, "holdout", "test")


def test_positions_are_a_sort(spark):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    got = S.positions(df, "d", per_bucket=5).orderBy("d").collect()
    assert [r.position for r in got] == list(range(500))
    assert S.positions(df.limit(0), "d").count() == 0


def test_runs_resume_under_one_fingerprint():
    one = P.fingerprint(config={"b": 1, "a": 2}, code="x")
    assert one == P.fingerprint(code="x", config={"a": 2, "b": 1})
    P.resume_gate(None, one)
    with pytest.raises(ValueError):
        P.resume_gate("other", one)


def test_codes_are_single_tokens_and_a_bijection(spark):
    # a tokenizer of characters, to which AA to AZ are one token each
    def encode(text):
        parts = F.regexp_extract_all(text, F.lit("(A[A-Z]|.)"), 1)
        return F.transform(parts, lambda x: F.ascii(x) * 1000 + F.ascii(F.substring(x, 2, 1)))

    got = P.single_token(P.letter_codes(spark), encode, ("x ", "y: ")).collect()
    assert len(got) == 26 and len({r.token_id for r in got}) == 26 and all(r.code[0] == "A" for r in got)
    names = spark.createDataFrame([("q", str(i)) for i in range(255)], "question string, candidate string")
    task = P.tasks(names, P.codebook(P.letter_codes(spark), 255, 1)).collect()
    assert len({r.code for r in task}) == len(task) == 255
    with pytest.raises(PySparkException):
        more = names.unionByName(spark.createDataFrame([("q", "one more")], names.schema))
        P.tasks(more, P.codebook(P.letter_codes(spark), 255, 1)).collect()


def test_predict_plugs_in_a_scorer(spark):
    rows = [("a", "choice", "s", "i", "[]", ["x", "yy"]), ("b", "score", "s", "i", "[]", ["0", "1", "2"]), ("c", "noul", "s", "i", "[]", ["false", "true"])]
    df = spark.createDataFrame(rows, "question string, kind string, state string, instructions string, criteria string, candidates array<string>")
    got = {r.question: r for r in D.predict(df, lambda paths: F.transform(paths, lambda p: F.length(p).cast("double"))).collect()}
    assert got["a"].choice.choice == "yy" and got["b"].score == pytest.approx(1) and got["c"].p_true < 0.5
    m = spark.createDataFrame([({"b": "2", "a": "1"},)], "m map<string, string>").select(D.reversed_order(F.col("m")).alias("r")).first().r
    assert m.order == ["b", "a"]


def test_jobs_see_all_prefixes(spark):
    # histories stand behind more plain prefixes than there are jobs
    rows = [(i, 0) for i in range(40)] + [(100 + i, 2) for i in range(3)]
    bounds = spark.createDataFrame(rows, "conv_id long, last_index int").repartition(4)
    plan = [{"slot": s, "form": f} for s, f in enumerate(["direct", "history_dependent"])]
    found = P.eligible(bounds, len(plan) * 3, "conv_id", F.col("last_index") > 0)
    got = sorted((r.attempt, r.slot, r.id) for r in P.assign(P.jobs_of(spark, plan), found).collect())
    assert sorted((s, a, i) for a, s, i in got) == greedy_jobs(plan, [(i, n > 0) for i, n in rows])
    assert [i for *_, i in got] == [0, 100, 1, 101, 2, 102]


def test_near_representatives_merge_exact_groups(spark, tmp_path):
    from weftline.plans import catalog

    rng = random.Random(17)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    near, far = base + " x", " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))
    # 0 is explored; 1 equals it, 2 is near it, 3 equals 2, 4 is another
    texts = [base, base, near, near, far]
    spark.createDataFrame([(i, t, "en", f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: (r.root, r.quarantine) for r in catalog.queries()["g5_two_phase"](spark, str(tmp_path)).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 3: (0, True), 4: (4, False)}


def test_codes_come_round_again_where_asked(spark):
    names = spark.createDataFrame([("q", f"{i:03}") for i in range(7)] * 2, "question string, candidate string")
    book = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "position int, code string")
    got = [r.code for r in sorted(P.tasks(names, book, repeat=True).collect(), key=lambda r: r.candidate)]
    assert len(got) == 7 and got[:3] == got[3:6] and got[0] == got[6] and len(set(got)) == 3


def test_balance_of_quotas_goes_below_zero(spark):
    df = spark.createDataFrame([("A",)] * 3, "source string")
    assert {tuple(r) for r in S.quota_balance(df, [("A", 1), ("B", 2)]).collect()} == {("A", 3, -2), ("B", 0, 2)}
    assert {tuple(r) for r in S.shortfall_table(df, [("A", 1), ("B", 2)]).collect()} == {("B", 2)}


def test_queries_equal_their_sql_beyond_codes_and_quotas(spark, tmp_path):
    import duckdb

    from weftline.plans import catalog, catalog_runs  # noqa: F401

    d = str(tmp_path)
    spark.range(600).selectExpr("id AS vec_id", "int(id % 2) AS label").write.parquet(f"{d}/embeddings.parquet")
    langs = "CASE WHEN id < 100003 THEN 'en' WHEN id < 100010 THEN 'de' ELSE 'it' END AS lang"
    spark.range(100_020).selectExpr("id AS doc_id", langs).write.parquet(f"{d}/documents.parquet")
    con = duckdb.connect()
    for name in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    for name in ("m11_task_codes", "w4_shortfalls"):
        got = sorted(tuple(r) for r in catalog.queries()[name](spark, d).collect())
        assert got == sorted(con.execute(catalog.oracle_sql()[name]).fetchall()), name


def test_join_of_texts_by_blocks_equals_that_of_arrays(spark, monkeypatch):
    from weftline.functions import text as T

    rng = random.Random(5)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60))]
        texts += [" ".join(words), " ".join(words), " ".join([*words[:-1], "x"])]
    texts += ["", " ", "ab", "AB", None]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, t string")
    plain = df.where("t IS NOT NULL").withColumn("tokens", T.shingles(T.normal(F.col("t"))))
    expected = {tuple(r) for r in J.threshold_join(plain, 80).collect()}
    # many blocks and parts
    for name, value in (("BLOCK_NODES", 4), ("BLOCKS", 1000), ("VERIFIED_ELEMENTS", 300)):
        monkeypatch.setattr(J, name, value)
    got = J.threshold_join(df, 80, tokens="t", cut=T.normal_shingles)
    assert {tuple(r) for r in got.collect()} == expected and len(expected) > 24
    assert {tuple(r) for r in J.lsh_join(df, 80, tokens="t", cut=T.normal_shingles).collect()} <= expected
    assert J.threshold_join(df.limit(0), 80, tokens="t", cut=T.normal_shingles).count() == 0


def test_sketches_bound_the_distance(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (3, 900, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.append(a[: n // 2], rng.integers(0, 2**63, n // 2).astype(np.uint64)))
        x, y = (np.frombuffer(J._sketch(s), np.uint64) for s in (a, b))
        k = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(z.reshape(-1, k), axis=0) for z in (x, y))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))
