"""Conversations, text functions, masking and strict JSON."""

import json
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import masking, requests, strict_json
from weftline.functions import text as T
from weftline.operators import conversations as C

MESSAGES = "messages array<struct<role: string, content: string>>"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def turns(spark, rows):
    return spark.createDataFrame([(c, t, r, x) for c, t, r, x in rows], "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize(("budget", "expected"), [(7, (0, 2)), (6, (0, 0)), (1, None)])
def test_prefix_budget_is_inclusive(spark, budget, expected):
    rows = turns(spark, [(1, 0, "user", "ab"), (1, 1, "assistant", "cde"), (1, 2, "user", "fg"), (1, 3, "user", "z" * 9)])
    got = C.prefix_bounds(rows, budget).collect()
    assert [(r.first_index, r.last_index) for r in got] == ([expected] if expected else [])


def test_prefixes_end_with_users_and_hash_their_messages(spark):
    rows = turns(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")])
    got = {r.prefix_index: r for r in C.prefixes(rows).collect()}
    assert {k: len(r.messages) for k, r in got.items()} == {0: 1, 2: 3}
    assert all(r.messages[-1].role == "user" for r in got.values())
    body = json.dumps([{"content": "a", "role": "user"}], separators=(",", ":"))
    assert got[0].prefix_sha256 == one(spark, T.digest(F.col("t")), t=body)


@pytest.mark.parametrize(
    ("messages", "reason"),
    [
        ([("user", "hi")], None),
        ([], "missing_messages"),
        (None, "missing_messages"),
        ([("tool", "x"), ("user", " ")], "unsupported_role"),
        ([("user", " \n"), ("tool", "x")], "empty_or_nontext_message"),
        ([("user", None)], "empty_or_nontext_message"),
        ([("assistant", "x")], "missing_user_turn"),
        ([None, ("user", "x")], "unsupported_role"),
    ],
)
def test_first_bad_message_gives_the_reason(spark, messages, reason):
    df = spark.createDataFrame([(messages,)], MESSAGES)
    assert df.select(C.reject_reason(F.col("messages")).alias("r")).first().r == reason


def test_normal_forms_are_idempotent_and_fold_width(spark):
    df = spark.createDataFrame([("ＡＢＣ　 x\n",), ("Straße",), (None,), ("",)], "t string")
    got = [r.x for r in df.select(T.normalize(F.col("t")).alias("x")).collect()]
    assert got == ["abc x", "strasse", None, ""]
    again = spark.createDataFrame([(x,) for x in got], "t string").select(T.normalize(F.col("t")).alias("x")).collect()
    assert [r.x for r in again] == got


def test_plain_characters_normalise_in_the_jvm(spark):
    import unicodedata

    plain = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and not re.search(T.SPECIAL.replace("\\x{9fff}", "\u9fff"), chr(c))]
    assert len(plain) > 20000 and all(unicodedata.normalize("NFKC", c) == c for c in plain)
    assert all(c.casefold() == c.lower() or c == "ß" for c in plain)
    texts = ["".join(plain[i : i + 500]) for i in range(0, len(plain), 500)] + ["ＡＢＣ ｄ", "ﬁne ΣΑΣ\u3000x", "e\u0301 É", " a\x1c\x1fb\u00a0c\u0085 ", "İI", None, "", "…½"]
    df = spark.createDataFrame([(t, [t, "ＡＢ", None]) for t in texts], "t string, a array<string>")
    got = df.select(T.normal(F.col("t")).alias("n"), T.normal_all(F.col("a")).alias("a")).collect()
    forms = [None if t is None else T.normal_form(t) for t in texts]
    assert [r.n for r in got] == forms and [r.a for r in got] == [[f, "ab", None] for f in forms]


def test_full_width_texts_share_their_keys(spark):
    text = "ABC def " * 20
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)
    keys = C.exact_keys(C.assemble(turns(spark, [(1, 0, "user", text), (2, 0, "user", wide)]))).collect()
    assert len({(r.kind, r.key) for r in keys}) == 2 and len(keys) == 4


def test_shared_documents_connect_different_questions(spark):
    article = "字" * 90
    rows = [(i, 0, "user", f"阅读下文\n{article}\n问题：{q}") for i, q in enumerate(("甲", "乙"))]
    keys = C.exact_keys(C.assemble(turns(spark, rows))).where("kind = 'document'")
    assert keys.select("key").distinct().count() == 1 and keys.count() == 2


def test_document_anchor_branches(spark):
    long = "word " * 40
    assert one(spark, T.document_anchor(F.col("t")), t=f"{long}\nwhy?") == long.strip()
    assert one(spark, T.document_anchor(F.col("t")), t="short\nwhy?") is None
    assert one(spark, T.document_anchor(F.col("t")), t=f"前提:{long}\n假设:x") == long.strip()
    assert one(spark, T.document_anchor(F.col("t")), t=f"{long}\nno question") is None


@pytest.mark.parametrize(("text", "profile"), [("abc", "no_cjk_not_necessarily_english"), ("字字a", "cjk_dominant"), ("字ab", "mixed_latin_dominant")])
def test_script_profile(spark, text, profile):
    assert one(spark, T.script_profile(F.col("t")), t=text) == profile


def test_privacy_flags_keep_their_order(spark):
    text = "13912345678 at 1.2.3.4 by a@b.co with sk-abcdefgh12"
    assert one(spark, T.privacy_flags(F.col("t")), t=text) == ["credential_pattern", "email", "ip_address", "mobile_number"]
    assert one(spark, T.privacy_flags(F.col("t")), t="1.2.3.4.5 913912345678") == []


@pytest.mark.parametrize("text", ["", "abc", "a\nbcdéf", "😀😀abcdef", "aaaaaaaa", "x" * 6])
def test_shingles_match_slices(spark, text):
    expected = {text[i : i + 5] for i in range(len(text) - 4)} or {text}
    assert set(one(spark, T.shingles(F.col("t")), t=text)) == expected


def test_jaccard_of_sets(spark):
    df = spark.createDataFrame([([1, 2], [1, 2, 3, 4]), ([], [])], "a array<int>, b array<int>")
    assert [r.j for r in df.select(T.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [0.5, 1.0]


def test_equal_values_share_a_placeholder():
    texts, counts = masking.sanitize(["user", "user"], ["a@x.org b@x.org", "again a@x.org 1.2.3.4"])
    assert texts == ["[REDACTED_EMAIL_1] [REDACTED_EMAIL_2]", "again [REDACTED_EMAIL_1] [REDACTED_IP_1]"]
    assert counts == {"EMAIL": 2, "IP": 1}
    with pytest.raises(ValueError):
        masking.sanitize(["assistant"], ["x"])


@pytest.mark.parametrize(
    ("text", "category"),
    [("ghp_abcdefghijkl", "TOKEN"), ("password = hunter2", "CREDENTIAL"), ("13912345678", "PHONE"), ("see /home/me/x", "PATH"), ("C:\\Users\\me", "PATH"), ("http://u:p@host", "URL_AUTH")],
)
def test_every_category_is_masked(spark, text, category):
    df = spark.createDataFrame([(["user"], [text])], "r array<string>, t array<string>")
    s = df.select(masking.sanitize_state("r", "t").alias("s")).first().s
    assert s.counts == {category: 1} and s.excluded == (category in masking.EXCLUDING)


@pytest.mark.parametrize("text", ['{"a": 1}', '```json\n{"a": 1}\n```', '```JSON \t\r\n{"a": "```"}\r\n```\n', '```\n\n{}\n\n```', '```\n{"a": [null, {"b": 1.5}]}\n```', "  {} "])
def test_strict_json_accepts(text):
    assert isinstance(strict_json.parse_object(text), dict)


@pytest.mark.parametrize(
    ("text", "reason"),
    [("{} {}", "invalid_json"), ('{"a":1,"a":2}', "duplicate_json_key"), ('{"x":{"a":1,"a":2}}', "duplicate_json_key"), ("[1]", "json_object_required"), ('{"a": NaN}', "nonfinite_json"), ('{"a": 1e999}', "invalid_json"), ("```json\n{}\n``` more", "invalid_json_fence"), ("```yaml\n{}\n```", "invalid_json_fence"), ("```json {}```", "invalid_json_fence"), ("```\n```", "invalid_json_fence"), ("```\n{}```", "invalid_json_fence"), ("", "invalid_json"), ("null", "json_object_required")],
)
def test_strict_json_rejects(text, reason):
    with pytest.raises(ValueError, match=reason):
        strict_json.parse_object(text)


def test_cut_answers_are_refused(spark):
    df = spark.createDataFrame([("length", [("text", "{}")]), ("end", [("text", '{"a":'), ("other", "x"), ("text", "1}")])], "stop string, blocks array<struct<type: string, text: string>>")
    got = [r.r for r in df.select(strict_json.parse_response(F.col("stop"), F.col("blocks")).alias("r")).collect()]
    assert got[0].reason == "truncated_response" and got[1].json == '{"a":1}'
    assert strict_json.finite({"a": [1, None]}) and not strict_json.finite({"a": float("inf")})


def test_budgets_and_seeds(spark):
    df = spark.createDataFrame([(2,), (255,), (1000,)], "k int").select(T.output_budget(F.col("k")).alias("b"))
    assert [r.b for r in df.collect()] == [4096, 20400, 24000]
    assert one(spark, T.seed_of(T.digest(F.col("t"))), t="") == 0xE3B0C442
    assert one(spark, T.serialize(F.col("t")), t='{"a":"<|x|>"}') == '{"a":"\\u003c|x|>"}'


CHOICE = {"type": "choice", "instructions": "pick", "criteria": {"a": "x", "b": None}}


@pytest.mark.parametrize(
    ("request_", "reason"),
    [
        ({"state": "s", "questions": {"q": CHOICE}}, None),
        ({"state": {"a": 1}, "questions": {"q": {"type": "noul", "instructions": "yes?"}}, "model": "m"}, None),
        ({"state": "s", "questions": {"q": CHOICE}, "x": 1}, "unknown_fields"),
        ({"questions": {"q": CHOICE}}, "missing_fields"),
        ({"state": 3, "questions": {"q": CHOICE}}, "invalid_state"),
        ({"state": "s", "questions": {}}, "question_count"),
        ({"state": "s", "questions": {f"q{i}": CHOICE for i in range(65)}}, "question_count"),
        ({"state": "s", "questions": {"q": {**CHOICE, "criteria": {"a": "x"}}}}, "choice_size"),
        ({"state": "s", "questions": {"q": {**CHOICE, "criteria": {str(i): "x" for i in range(256)}}}}, "choice_size"),
        ({"state": "s", "questions": {"q": {**CHOICE, "criteria": {"a": "", "b": "x"}}}}, "invalid_description"),
        ({"state": "s", "questions": {"q": {"type": "score", "instructions": "i", "criteria": ["x"] * 11}}}, "score_size"),
        ({"state": "s", "questions": {"q": {"type": "noul", "instructions": "i", "criteria": {}}}}, "invalid_question_fields"),
        ({"state": "s", "questions": {"q": {"type": "rank", "instructions": "i"}}}, "unsupported_type"),
        ({"state": "s", "questions": {"q": CHOICE}, "model": ""}, "invalid_model"),
    ],
)
def test_requests(request_, reason):
    assert requests.request_error(request_) == reason


def test_requests_as_text(spark):
    rows = [(json.dumps({"state": "s", "questions": {"q": CHOICE}}),), ("{} {}",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(requests.validate_requests("t").alias("r")).collect()
    assert [r.r for r in got] == [None, "invalid_json", "invalid_json"]


def test_registered_keys_have_quoted_documents(spark, tmp_path):
    from weftline.plans import catalog

    quoted = " ".join(f"word{i}" for i in range(60))
    rows = [(1, 0, "user", quoted + "\nWhat does it say?"), (2, 0, "user", quoted + "\nWho wrote this one?")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalog.queries()["f7_exact_keys"](spark, str(tmp_path)).where("kind = 'document'").collect()
    assert {r.conv_id for r in got} == {1, 2} and len({r.key for r in got}) == 1


def test_hashed_shingles_stand_for_the_shingles(spark):
    texts = ["", "abc", "abcd", "abcde", "abcdeabcde", "x\U0001f600\U0001f600yzw\U0001f600\U0001f600yzw", "\u00df \ufb01\u3000A" * 9, "abca", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = df.select("i", T.normal(F.col("t")).alias("n"), F.size(T.shingles(T.normal(F.col("t")))).alias("a"), T.count_normal_shingles(F.col("t")).alias("b"))
    rows = got.where("t IS NOT NULL").collect()
    assert [r.a for r in rows] == [r.b for r in rows] == [len({r.n[i : i + 5] for i in range(max(1, len(r.n) - 4))}) for r in rows]
    assert len({tuple(T.normal_shingles(t)) for t in texts[:4]}) == 4 and got.where("t IS NULL").first().b is None


def test_a_normal_form_is_evaluated_once(spark, capsys):
    found = spark.range(1).select(T.normal(F.concat(F.col("id").cast("string"), F.lit("x"))).alias("n"))
    found.explain()
    assert capsys.readouterr().out.split("== Physical Plan ==")[1].count("concat(") == 1
