"""Quality rules, URL filters, personal data, licences, decontamination: operators that judge a row at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import decontamination, licenses, pii, quality, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE_TEXTS = [None, "", " \n\t", "one", "a b c d e f g h i j k", "x\x0by\x0cz", "é😀 ü", "a " * 3000, "l one.\nl one.\n\nl one.", "w1 w2 w3 w4 w5 w1 w2 w3 w4 w5 w6"]


def docs(spark, texts, extra=""):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def repeated_words(ws):
    seen, covered = {}, set()
    for i in range(len(ws) - 4):
        seen.setdefault(tuple(ws[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + j for i in at for j in range(5))
    return len(covered)


def base_quality(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = repeated_words(ws)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), n, len(ws) < 10 or 100 * n > 20 * len(ws))


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(5)
    texts = EDGE_TEXTS + ["".join(rng.choice(["a ", "b ", "c\n", "# ", "dd\t"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    got = quality.judge(docs(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_quality(t), t
        assert not (r.kept and r.base_failed)


PROSE = "The river runs past the old mill and under the bridge.\nNobody has seen the boat since the storm of last winter."


def test_lines_that_fail_go_and_too_much_loss_rejects(spark):
    menu = "Home | News | Sport | Contact"
    texts = [PROSE, f"{menu}\n{PROSE}\nSubscribe to our letter", f"{menu}\n" * 20 + PROSE, "### *** %%% words and &&& signs $$$ here"]
    got = quality.judge(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, True, False, False]
    assert got[1].cleaned_text == PROSE
    kept = quality.clean(docs(spark, texts).withColumn("n_words", F.lit("mine"))).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.n_words) for r in kept] == [(0, PROSE, "mine"), (1, PROSE, "mine")]


def test_quality_of_empty_tables_and_clashing_columns(spark):
    assert quality.judge(docs(spark, [])).count() == 0 and quality.clean(docs(spark, [])).count() == 0
    got = quality.judge(docs(spark, [PROSE, PROSE]).withColumn("kept", F.lit("x")).withColumn("lang", F.lit("en")))
    assert got.columns[:3] == ["doc_id", "text", "lang"] and [r.kept for r in got.collect()] == [True, True]


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("org", "/es/", "allow"), (None, "/", "block")]
URLS = ["http://a.example.com/en/74?x=1", "https://EXAMPLE.com/en/8", "x://net/de/8#f", "http://b.example.net/de/81", "http://org/es/", "http://org/es", "http://notexample.com/en/7", "noscheme/en/", "", None, "http://h", "http://h?x/://com/en/", "a://b://com/en/", "http://com:80/en/", "http://Ö.com/en/7"]


def judged(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), len(p), h + p, a) for h, p, a in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("broadcast", [urls.BROADCAST_RULES, 0])
def test_rules_match_brute_force_either_way(spark, broadcast):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = urls.filter_urls(pages, rules, broadcast_rules=broadcast).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [judged(u) for u in URLS + URLS[:2]]


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, action string")
    assert urls.filter_urls(pages, none).first().verdict == "allow"
    assert urls.filter_urls(pages.limit(0), none).count() == 0


def luhn_slow(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn_slow(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_match_the_patterns():
    rng = random.Random(9)
    parts = ["a", "Z.", "@", "1", "23", ".", " ", "-", "+", "(", "4111 1111 1111 1111", "a@b.co", "10.0.0.1", "256", "+1 (555) 123-4567", "é", "😀", "@x.y", "%"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s[:3] for s in pii.find(t) if s[0] in pii.BASE] == base_spans(t), t


@pytest.mark.parametrize(
    ("text", "kind"),
    [("transfer to DE89 3704 0044 0532 0130 00 UND", "iban"), ("amex card 378282246310005", "card_short"), ("call (555) 123-4567 now", "phone_local"), ('token = "04dbebab91ab85687d33eeaaf9"', "secret")],
)
def test_added_kinds(text, kind):
    assert kind in {s[0] for s in pii.find(text)}


def test_checksums_and_context_decide():
    assert not pii.find("number 378282246310005") and not pii.find("call DE88 3704 0044 0532 0130 00")
    assert pii.masked("me a@b.co!", pii.find("me a@b.co!")) == "me [EMAIL]!"


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "A" * 200_000 + "1"):
        pii.find(t)


def test_detection_table(spark):
    texts = ["a@b.co", None, "", "a@b.co"]
    df = docs(spark, texts).withColumn("spans", F.lit("mine"))
    got = pii.detect(df).orderBy("doc_id").collect()
    assert [r.n_email for r in got] == [1, 0, 0, 1] and [r.masked for r in got] == ["[EMAIL]", None, "", "[EMAIL]"]
    assert got[0].spans == "email:0:6" and pii.detect(docs(spark, [])).count() == 0


def contained(text, item, k=5):
    d, i = (WORD.findall((x or "").lower()) for x in (text, item))
    if not i:
        return None
    k = min(k, len(i))
    want = {tuple(i[j : j + k]) for j in range(len(i) - k + 1)}
    have = {tuple(d[j : j + k]) for j in range(len(d) - k + 1)}
    return len(want & have) / len(want)


@pytest.mark.parametrize("block", [decontamination.BLOCK_SHINGLES, 40])
def test_containment_matches_brute_force(spark, block):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 3, 5, 6, 12, 20, 40, 40)] + ["", None]
    items[7] = items[6]
    texts = [None, "", "w1"]
    for _ in range(40):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        ws = WORD.findall(rng.choice(items[:8]))
        if rng.random() < 0.5 and ws:
            ws[rng.randrange(len(ws))] = "other"
        at = rng.randint(0, len(body))
        texts.append(" ".join(body[:at] + ws + body[at:]).title())
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontamination.contaminated(docs(spark, texts), bench, block_shingles=block).collect()}
    expected = {(i, j): c for i, t in enumerate(texts) for j, x in enumerate(items) if (c := contained(t, x)) is not None and c >= 0.8}
    assert got == pytest.approx(expected) and expected


def test_sketches_cover_the_threshold():
    for n in range(1, 400):
        misses = n - -(-4 * n // 5)  # n - ceil(0.8 n)
        assert decontamination.sketch_size(n, 0.8) >= min(n, misses + 1)


def test_clean_keeps_rows_and_columns(spark):
    df = docs(spark, ["a b c d e f", "x y z", None]).withColumn("_hits", F.lit(1)).withColumn("item_id", F.lit(2))
    bench = spark.createDataFrame([(1, "A b c d e")], "item_id long, text string")
    for block in (decontamination.BLOCK_SHINGLES, 4):
        named = df.withColumn("_hits", F.lit(1)).withColumn("row", F.lit(2)).withColumn("_key", F.lit(3))
        again = decontamination.clean(named, bench, block_shingles=block)
        assert again.columns == named.columns and again.select("doc_id", "text").collect() == decontamination.clean(df, bench).select("doc_id", "text").collect()
    got = decontamination.clean(df, bench)
    assert sorted(r.doc_id for r in got.collect()) == [1, 2] and "item_id" in got.columns
    assert decontamination.clean(df, bench.limit(0)).count() == 3


@pytest.fixture(scope="module")
def licence_model():
    rng = random.Random(4)
    return licenses.train([" ".join(rng.choice(["the", "of", "river", "under", "work", "public", "is", "general"]) for _ in range(12)) for _ in range(300)])


def test_templates_are_recognised(licence_model):
    m = licence_model
    hits = sum((m.families + ["unknown"])[m.probabilities(t).argmax()] == f for f, ts in licenses.TEMPLATES.items() for t in ts)
    assert hits >= 0.95 * sum(map(len, licenses.TEMPLATES.values()))
    assert all(m.probabilities(x).argmax() == len(m.families) for x in licenses.NEARBY)


def test_rules_with_very_long_hosts(spark):
    # 130 labels, by the lookup, by shapes, and by every prefix
    host = ".".join(["a"] * 130)
    rules = spark.createDataFrame([(host, "/x", "block"), ("a", "/x/y", "allow"), ("a", "/x", "block"), ("", "", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, f"http://b.{host}/x", 7, "s"), (2, f"http://{host}/x/y", 8, "t"), (3, "http://c/x", 9, "u"), (4, None, 0, "v"), (5, "http://b.a/x/y?z", 1, "w")], "page_id long, url string, n int, _best string")
    expected = {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    for limit, shapes in ((urls.BROADCAST_RULES, urls.BROADCAST_SHAPES), (0, urls.BROADCAST_SHAPES), (0, 0)):
        urls.BROADCAST_SHAPES, old = shapes, urls.BROADCAST_SHAPES
        got = urls.filter_urls(pages, rules, broadcast_rules=limit).collect()
        urls.BROADCAST_SHAPES = old
        assert {r.page_id: r.verdict for r in got} == expected and {r["_best"] for r in got} == set("stuvw")


def test_verdicts_keep_the_columns_of_a_table(spark):
    df = spark.createDataFrame([(1, PROSE, ["x"], "y", 5)], "doc_id long, text string, _w array<string>, _w_text string, kept int")
    row = quality.judge(df).first()
    assert row["_w"] == ["x"] and row["_w_text"] == "y" and row.kept is True and row.text == PROSE
    assert quality.clean(df).first()["_w"] == ["x"]


# Notices of licences that training hasn't seen, and wording that several families share.
UNSEEN = (
    "Licensed under the Eclipse Public License 2.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.",
    "Licensed under the Microsoft Public License.",
    "Licensed under the EUPL, Version 1.2 or later.",
    "Licensed under the European Union Public Licence.",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: MS-PL",
    "Released under the Zope Public License 2.1.",
    "This work is licensed under a Creative Commons",
    "Released under the terms of the",
    "SPDX-License-Identifier:",
)


def test_unseen_licences_are_unknown(spark, licence_model):
    m = licence_model
    assert all(m.probabilities(x).argmax() == len(m.families) for x in UNSEEN), [x for x in UNSEEN if m.probabilities(x).argmax() < len(m.families)]
    wrapped = "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."
    got = licenses.scan(docs(spark, [*UNSEEN, wrapped]), m).collect()
    assert [(r.doc_id, r.family, r.confirmed) for r in got] == [(len(UNSEEN), "cc-by-sa", True)]


def test_templates_are_compared_in_order(spark, licence_model):
    good = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    ws = good.split()
    parts = [ws[i : i + 3] for i in range(0, len(ws), 3)]
    turned = " ".join(" ".join(p) for p in parts[::-1])
    got = {r.doc_id: r for r in licenses.scan(docs(spark, [good, turned]), licence_model).collect()}
    assert got[0].confirmed and got[0].family == "mit" and (1 not in got or not got[1].confirmed)


def test_prefilter_loses_nothing(spark, licence_model):
    # every text with a family by the plain model is a row of the scan
    rng = random.Random(13)
    some = [w for ts in licenses.TEMPLATES.values() for t in ts for w in t.split()]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(2, 30))) for _ in range(250)]
    texts += [" ".join(t.split()[: rng.randint(2, 9)]) for ts in licenses.TEMPLATES.values() for t in ts]
    got = {r.doc_id for r in licenses.scan(docs(spark, texts), licence_model).collect()}
    m = licence_model
    expected = {i for i, t in enumerate(texts) if (p := m.probabilities(t))[:-1].max() > p[-1]}
    assert got == expected and len(expected) > 20


def test_scan_ignores_other_columns(spark, licence_model):
    df = spark.createDataFrame([(1, "Released under the MIT License.", 5, "x", 0.5)], "doc_id long, text string, line int, t string, u double")
    assert [(r.doc_id, r.line, r.family) for r in licenses.scan(df, licence_model).collect()] == [(1, 0, "mit")]


def test_scan_computes_the_model(spark, licence_model):
    lines = ["Released under the MIT License.", "Nothing here.", "", "This work is licensed under the GNU General Public License, version 3.", "foo Licensed under CC BY-NC 4.0. bar", "mit license", "SPDX-License-Identifier: Apache-2.0"]
    df = docs(spark, ["\n".join(lines), None, "", "plain words", lines[0], lines[0]])
    got = licenses.scan(df, licence_model).collect()
    m = licence_model
    for i, line in enumerate(lines):
        p = m.probabilities(line)
        row = [r for r in got if r.doc_id == 0 and r.line == i]
        if p[:-1].max() > p[-1]:
            assert row[0].family == m.families[p.argmax()] and row[0].probability == pytest.approx(p.max(), abs=1e-5)
        else:
            assert not row, line
    assert {r.doc_id for r in got} == {0, 4, 5} and all(r.confirmed for r in got if r.doc_id > 0)
    assert licenses.scan(df.limit(0), m).count() == 0


def test_wrapped_and_long_paragraphs(spark, licence_model):
    prose = " ".join(f"plain{i} words of the river under a bridge" for i in range(60))
    lesser = "licensed under the GNU Lesser General Public License, version 2.1."
    texts = [
        "Licensed under the GNU Lesser\nGeneral Public License, version 2.1.",
        "# This work is licensed under a Creative Commons\n# Attribution-NonCommercial 4.0 International License.",
        f"{prose} {lesser} {prose}",
        f"Released under the MIT License. {prose} {lesser}",
        "Released under the MIT License.\n\nLicensed under the GNU Lesser\n\nGeneral Public License",
    ]
    got = licenses.scan(docs(spark, texts), licence_model).collect()
    of = lambda i: [(r.line, r.lines, r.family, r.confirmed) for r in sorted(got, key=lambda r: (r.line, r.word)) if r.doc_id == i]
    assert of(0) == [(0, 2, "lgpl", True)] and of(1) == [(0, 2, "cc-by-nc", True)]
    assert of(2) == [(0, 1, "lgpl", True)] and of(3) == [(0, 1, "mit", True), (0, 1, "lgpl", True)]
    assert all(r.lines == 1 for r in got if r.doc_id == 4)


def test_long_prose_keeps_quotations_and_phrases(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(f"mot{rng.randrange(10**6)}" for _ in range(n))
    french = " ".join(f"Le voisin {some(3)} a dit « {some(5)} » {some(3)}." for _ in range(8))
    german = " ".join(f"Der Nachbar {some(3)} rief »{some(5)}« {some(3)}." for _ in range(8))
    policy = f"{some(60)}. One speaker mentioned the privacy policy once. {some(20)}."
    menus = ["Home » News » Sport » Contact us.", "Please see our privacy policy.", "Home | News | « Sport » | Contact."]
    got = {r.doc_id: r.text for r in quality.clean(docs(spark, [french, german, policy, *(f"{m}\n{PROSE}" for m in menus)])).collect()}
    assert got == {0: french, 1: german, 2: policy, 3: PROSE, 4: PROSE, 5: PROSE}
