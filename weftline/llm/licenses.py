"""License scans: a trained paragraph classifier, an unknown class, and templates that confirm what it says.

Model: softmax regression over the presence of word uni- and bigrams, made sparse by an L1 penalty. It is fitted on the
driver from the templates below (spans of them, with words dropped and surrounded by others). The unknown class has
notices of other licences, the same sentences about licences with made-up names, spans that templates of two families
share, and lines of a bounded sample of documents (SAMPLE_DOCS, the first by a hash of their ids) without those that
hold a template's wording. Temperature and the unknown class's offset are calibrated on a held-out third of the examples;
other licences are held out whole, so the unknown class is calibrated on licences that it hasn't seen.

Scan: built-in expressions only. A paragraph is a line and those after it, while a bigram of a template spans the break, so
a wrapped notice is seen whole, and notices on lines of their own stay apart. Longer paragraphs are judged in overlapping
windows; of windows that find the same place, the best counts. A document or window is looked at closely only where it
has a word without which no family can reach the unknown class, so nothing is lost. Scores are sums over the features
present, probabilities their softmax. A prediction is confirmed where enough of the bigrams in the best stretch stand, in
order, in one template of that family. No shuffle; a document with many licence notices gives many rows.

Defined results: null and empty texts have no lines that count; repeated documents and lines give repeated rows; of
families and templates that tie, the first by name and order counts; very long texts and lines are judged in windows, whole;
of docs only the id and the text are read, whatever other columns are called; an empty table gives an empty result. Words
are runs of letters, digits, dots and hyphens, in lower case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.sampling import first_by_hash

# Notices of each family, as they stand in files and on pages.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Released under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Available under the Creative Commons Attribution License.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Available under CC BY-NC-SA 4.0 for noncommercial use.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal",
        "This work is dedicated to the public domain under CC0.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "mit": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "This project is licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}
# Lines near licences that are none.
NEARBY = (
    "His driving license expired in version 2 of the story.",
    "The public library is open and free of charge to any person.",
    "She asked for permission to use the source of the river.",
    "Students at MIT released a study under general conditions.",
    "The apache helicopter landed near the mozilla office.",
    "A license plate was found at the creative commons house.",
    "Fishing licenses are granted by the state without restriction.",
    "The work is dedicated to the author of the following conditions.",
)
# Notices of licences that have no family here, by name.
OTHERS: dict[str, tuple[str, ...]] = {
    "affero": ("This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "artistic": ("This library is distributed under the terms of the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"),
    "boost": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "cddl": ("The contents of this file are subject to the terms of the Common Development and Distribution License.", "SPDX-License-Identifier: CDDL-1.0"),
    "cpl": ("This program is made available under the terms of the Common Public License v1.0.", "Licensed under the Common Public License 1.0."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."),
    "odbl": ("This data is made available under the Open Database License.", "Licensed under ODbL 1.0."),
    "ofl": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"),
    "postgresql": ("Released under the PostgreSQL License, a liberal open source license.", "Licensed under the PostgreSQL License."),
    "python": ("Licensed under the Python Software Foundation License Version 2.", "SPDX-License-Identifier: PSF-2.0"),
    "qpl": ("This file may be distributed under the terms of the Q Public License as defined by Trolltech.", "Licensed under the Q Public License 1.0."),
    "reciprocal": ("Released under the Reciprocal Public License 1.5.", "This work is licensed under the Reciprocal Public License, version 1.5."),
    "wtfpl": ("Released under the terms of the Do What You Want To Public License, Version 2.", "SPDX-License-Identifier: WTFPL"),
    "zlib": ("This software is provided as-is, without any express or implied warranty, under the zlib license.", "SPDX-License-Identifier: Zlib"),
}
# Sentences that made-up names fill.
SENTENCES = (
    "Licensed under the {x} Public License, version {n}.",
    "Licensed under the {x} Public License {n}.",
    "Licensed under the {x} License, Version {n}.",
    "This work is licensed under the {x} Public License.",
    "This work is licensed under a {x} license.",
    "Released under the {x} License.",
    "Released under the {x} {n} or later.",
    "This project is licensed under the {x} license.",
    "This file is subject to the terms of the {x} Public License, v. {n}.",
    "Use of this source code is governed by the {x} license that can be found in the LICENSE file.",
    "Available under the {x} License for any use.",
    "Licensed under {x} {n}.",
    "SPDX-License-Identifier: {x}-{n}",
    "You may redistribute this program under the terms of the {x} General License as published by {x}.",
    "Permission is granted to any person to use this software under {x} terms.",
)
UNKNOWN = "unknown"
SAMPLE_DOCS = 400
LINES_PER_DOC = 10
#: Words of a window, and from one window to the next; the longest template fits in what two neighbours share.
WINDOW, STRIDE = 64, 32
#: Share of the best stretch of bigrams that a template must have.
CONFIRM = 0.6
_WORD = r"[\p{L}\p{N}][\p{L}\p{N}.-]*"
_PY_WORD = re.compile(r"[^\W_](?:[^\W_]|[.-])*")


def tokens(line: str) -> list[str]:
    return [w.rstrip(".-") for w in _PY_WORD.findall(line.lower())]


def grams(ws: list[str]) -> list[str]:
    return [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))]


@dataclass
class Model:
    families: list[str]  # without the unknown class
    features: list[str]
    weights: np.ndarray  # features x families, already divided by the temperature
    offsets: np.ndarray  # of families, relative to the unknown class, likewise
    common: dict[str, int]  # lines of the sample that have a word

    def probabilities(self, line: str) -> np.ndarray:
        """Of the families, then of the unknown class; what the scan computes, in plain Python."""
        have = set(grams(tokens(line)))
        z = self.offsets + sum((self.weights[i] for i, f in enumerate(self.features) if f in have), np.zeros(len(self.families)))
        e = np.exp(np.append(z, 0.0) - max(z.max(), 0.0))
        return e / e.sum()


def _examples(lines: list[str], rng: np.random.Generator) -> tuple[list[set[str]], list[int], list[bool]]:
    """Features, labels and whether held out for calibration, of the examples."""
    families = sorted(TEMPLATES)
    unknown = len(families)
    filler = [w for line in lines for w in tokens(line)] or ["text"]
    sets, labels, held = [], [], []

    def add(ws: list[str], label: int, apart: bool) -> None:
        around = [filler[int(i)] for i in rng.integers(0, len(filler), int(rng.integers(0, 9)))]
        sets.append(set(grams(around[::2] + ws + around[1::2])))
        labels.append(label)
        held.append(apart)

    whole = {f: [" ".join(["", *tokens(t), ""]) for t in TEMPLATES[f]] for f in families}
    for label, family in enumerate(families):
        for template in TEMPLATES[family]:
            ws = tokens(template)
            for copy in range(24):
                n = len(ws) if copy % 3 == 0 else max(min(4, len(ws)), int(len(ws) * rng.uniform(0.6, 1)))
                at = int(rng.integers(0, len(ws) - n + 1))
                span = ws[at : at + n]
                # wording that another family's template has too says nothing
                shared = any(" ".join(["", *span, ""]) in t for f in families if f != family for t in whole[f])
                add([w for w in span if n < 6 or rng.random() > 0.05], unknown if shared else label, rng.random() < 1 / 3)
            for copy in range(3):
                n = int(rng.integers(2, max(3, len(ws))))
                span = ws[: n] if copy else ws[-n:]
                if any(" ".join(["", *span, ""]) in t for f in families if f != family for t in whole[f]):
                    add(span, unknown, rng.random() < 1 / 3)
    for k, name in enumerate(sorted(OTHERS)):
        for line in OTHERS[name]:
            for _ in range(8):
                add(tokens(line), unknown, k % 3 == 0)
    for sentence in SENTENCES:
        for copy in range(16):
            name = " ".join(filler[int(i)] for i in rng.integers(0, len(filler), 1 + copy % 2))
            add(tokens(sentence.format(x=name, n=f"{int(rng.integers(1, 5))}.{int(rng.integers(0, 3))}")), unknown, copy % 3 == 0)
    for line in [*lines, *(x for x in NEARBY for _ in range(6))]:
        sets.append(set(grams(tokens(line))))
        labels.append(unknown)
        held.append(rng.random() < 1 / 3)
    return sets, labels, held


def _wording(ws: list[str]) -> float:
    """The largest share of a template's bigrams that the words have."""
    have = set(zip(ws, ws[1:], strict=False))
    pairs = [list(zip(t, t[1:], strict=False)) for ts in TEMPLATES.values() for t in map(tokens, ts)]
    return max(sum(p in have for p in own) / max(2, len(own)) for own in pairs)


def train(lines: list[str], l1: float = 2e-4, steps: int = 400, seed: int = 7) -> Model:
    """Proximal gradient descent on the softmax loss; lines are examples of the unknown class."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    plain = [x for x in lines if _wording(tokens(x)) < CONFIRM / 2]
    sets, labels, held = _examples(plain, rng)
    held = np.array(held)
    features = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(tokens(t))})
    place = {f: i for i, f in enumerate(features)}
    x = np.zeros((len(sets), len(features) + 1))
    for row, s in enumerate(sets):
        x[row, [place[g] for g in s if g in place]] = 1
    x[:, -1] = 1
    y = np.eye(len(families) + 1)[labels]
    # each family counts alike, and the unknown class as much as all of them
    mass = 1 / (y[~held].sum(0) + 1)
    mass[-1] *= len(families)
    w, v, rate = np.zeros((x.shape[1], y.shape[1])), np.zeros((x.shape[1], y.shape[1])), 2.0
    xt, yt = x[~held], y[~held]
    sample = (yt @ mass)[:, None] / (yt @ mass).sum()
    for _ in range(steps):
        z = xt @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        v = 0.9 * v + xt.T @ (sample * (yt - p))
        w += rate * v * 0.1
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * l1, 0)
    w -= w[:, -1:]
    # calibration on the held-out part: temperature and the unknown class's offset with the least loss
    z, yh = x[held] @ w, y[held]
    weight = (yh @ (1 / (yh.sum(0) + 1) * np.append(np.ones(len(families)), len(families))))
    weight /= weight.sum()
    best = (np.inf, 1.0, 0.0)
    for t in (0.25, 0.5, 0.75, 1.0, 1.5):
        for b in np.arange(-2.0, 4.1, 0.5):
            s = z / t
            s[:, -1] += b
            top = s.max(1)
            loss = float((weight * (np.log(np.exp(s - top[:, None]).sum(1)) + top - (s * yh).sum(1))).sum())
            best = min(best, (loss, t, float(b)))
    _, t, b = best
    kept = np.flatnonzero(np.abs(w[:-1, :-1]).max(1) > 0)
    common = Counter(x for line in lines for x in set(tokens(line)))
    return Model(families, [features[i] for i in kept], w[kept, :-1] / t, w[-1, :-1] / t - b, common)


def sample_lines(docs: DataFrame, doc_id: str, text: str, n: int) -> list[str]:
    """Lines of the sample of n documents, the first LINES_PER_DOC * n of them."""
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    picked = first_by_hash(rows, n, F.xxhash64("i", "t", F.lit(2)), "i", "t").collect()
    return [line for r in picked for line in r["t"].split("\n") if line.strip()][: LINES_PER_DOC * n]


def _literal(values: list) -> Column:
    """A constant array, made from one string so that the plan has one node instead of one for each value."""
    parts = F.split(F.lit("\x01".join(map(str, values))), "\x01")
    return parts.cast("array<double>") if isinstance(values[0], float) else parts


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line (from 0), lines, word, family, probability, overlap, confirmed: a row for each place that the model takes for a notice.

    lines: how many lines are judged as one; word: where the window begins in them.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    rows = rows.where(F.arrays_overlap(F.split("t", r"[^\p{L}\p{N}]+"), _literal(_needed(model))))
    units = rows.select("doc_id", F.explode(_units(F.col("t"))).alias("u")).select("doc_id", "u.line", "u.lines", "u.ws")
    needed = _literal(_needed_words(model))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("ws") - WINDOW) / STRIDE), F.lit(0)).cast("int") * STRIDE, F.lit(STRIDE))
    part = lambda i: F.slice("ws", i + 1, F.lit(WINDOW))
    # values that are used more than once are bound as lambda variables: as columns, the optimizer would copy their definitions
    judged = lambda i: _let(part(i), lambda w: _let(_pairs(w), lambda p: _let(_places(model, w, p), lambda at: _verdict(model, p, at, i, F.size(w)))))
    close = F.filter(F.transform(F.filter(starts, lambda i: F.arrays_overlap(part(i), needed)), judged), lambda r: r["logit"] > 0)
    found = units.select("doc_id", "line", "lines", F.explode(_let(close, _best)).alias("r"))
    return found.select(
        "doc_id",
        "line",
        "lines",
        F.col("r.start").cast("long").alias("word"),
        "r.family",
        F.round("r.probability", 6).alias("probability"),
        F.round("r.overlap", 6).alias("overlap"),
        (F.col("r.overlap") >= CONFIRM).alias("confirmed"),
    )


def _units(text: Column) -> Column:
    """line, lines, ws: lines, or several of a paragraph where bigrams of the templates span their breaks."""
    words = lambda line: F.transform(F.regexp_extract_all(line, F.lit(rf"({_WORD})"), 1), lambda w: F.regexp_replace(w, r"[.-]+$", ""))
    spanning = _literal(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(tokens(t)) if " " in g}))

    def of(ls: Column) -> Column:
        ends = lambda i: F.concat(F.try_element_at(F.get(ls, i - 1), F.lit(-1)), F.lit(" "), F.get(F.get(ls, i), F.lit(0)))
        heads = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: ~F.coalesce(F.array_contains(spanning, ends(i)), F.lit(False)))
        return _let(heads, lambda hs: F.transform(hs, lambda h, k: unit(ls, h, F.coalesce(F.get(hs, k + 1), F.size(ls)) - h)))

    def unit(ls: Column, head: Column, n: Column) -> Column:
        ws = F.when(n > 1, F.flatten(F.slice(ls, head + 1, n))).otherwise(F.get(ls, head))
        return F.struct(head.cast("long").alias("line"), n.cast("long").alias("lines"), ws.alias("ws"))

    return _let(F.transform(F.split(text, "\n"), words), of)


def _best(found: Column) -> Column:
    """Without the windows whose stretch another, more certain window has too (at equal logits, an earlier one)."""
    beaten = lambda r, o: (
        (o["start"] != r["start"])
        & (o["from"] <= r["to"])
        & (r["from"] <= o["to"])
        & ((o["logit"] > r["logit"]) | ((o["logit"] == r["logit"]) & (o["start"] < r["start"])))
    )
    return F.filter(found, lambda r: ~F.exists(found, lambda o: beaten(r, o)))


def _needed(model: Model) -> list[str]:
    """Runs of letters and digits of which a text with any predicted place has at least one: the longest of each needed word."""
    return sorted({max(re.findall(r"[^\W_]+", w), key=len) for w in _needed_words(model)})


def _needed_words(model: Model) -> list[str]:
    """Words of which any predicted place has at least one.

    A feature is as common as its rarest word. The most common features whose sum stays under what a family needs can't
    make it win by themselves; a line of the family has one of its other features, hence that feature's rarest word.
    """
    rarest = [min(f.split(" "), key=lambda w: (model.common.get(w, 0), -len(w))) for f in model.features]
    out = set()
    for j, offset in enumerate(model.offsets):
        order = [i for i in np.argsort(model.weights[:, j]) if model.weights[i, j] > 0]
        order.sort(key=lambda i: -model.common.get(rarest[i], 0))
        reach = np.cumsum([model.weights[i, j] for i in order])
        for i, sum_ in zip(order, reach, strict=True):
            if sum_ + offset > 0:
                out.add(rarest[i])
    return sorted(out) or ["none"]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _pairs(ws: Column) -> Column:
    """Bigrams of a line."""
    many = F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.concat(F.get(ws, i), F.lit(" "), F.get(ws, i + 1)))
    return F.when(F.size(ws) > 1, many).otherwise(F.split(F.lit(""), " "))


def _places(model: Model, ws: Column, pairs: Column) -> Column:
    """Places, from 1, of the model's features that a line has."""
    features = _literal(model.features)
    return F.transform(F.array_intersect(F.concat(ws, pairs), features), lambda g: F.array_position(features, g).cast("int"))


def _verdict(model: Model, pairs: Column, at: Column, start: Column, size: Column) -> Column:
    logits = [_dot(_literal([float(x) for x in model.weights[:, j]]), float(model.offsets[j]), at) for j in range(len(model.families))]
    templates = F.array(*[F.array(*[_literal(list(dict.fromkeys(g for g in grams(tokens(t)) if " " in g))) for t in TEMPLATES[f]]) for f in model.families])

    def of(z: Column) -> Column:
        top = F.array_max(z)
        best = F.array_position(z, top).cast("int")
        total = F.aggregate(z, F.exp(-top), lambda s, x: s + F.exp(x - F.array_max(z)))
        family, probability = F.element_at(_literal(model.families), best), 1 / total
        # of the family's templates, the one with the largest overlap
        stretch = F.when(top > 0, F.array_max(F.transform(F.element_at(templates, best), lambda t: _stretch(pairs, t))))
        return _let(stretch, lambda s: F.struct(top.alias("logit"), probability.alias("probability"), family.alias("family"), start.alias("start"), *place(s)))

    def place(s: Column) -> list[Column]:
        # without a shared bigram, a window's place is the whole of it
        ends = {"from": start + s["from"], "to": start + s["to"] + 1}
        return [s["overlap"].alias("overlap"), *(F.when(s["overlap"] > 0, v).otherwise(start if k == "from" else start + size - 1).alias(k) for k, v in ends.items())]

    return _let(F.array(*logits), of)


def _stretch(pairs: Column, template: Column) -> Column:
    """overlap, from, to: the best stretch of bigrams, and the share of it (of two bigrams at least) that the template has in this order.

    Each shared bigram outweighs gaps of a few others; the stretch with the greatest sum is the best.
    """
    gap = CONFIRM / 2
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(0.0).alias("best"), F.lit(0).alias("from"), F.lit(-1).alias("to"), F.lit(0).alias("i"))

    def step(s: Column, pair: Column) -> Column:
        x = F.when(F.array_contains(template, pair), F.lit(1 - gap)).otherwise(F.lit(-gap))
        now = F.struct((F.greatest(s["sum"], F.lit(0.0)) + x).alias("sum"), F.when(s["sum"] > 0, s["start"]).otherwise(s["i"]).alias("start"))
        return _let(now, lambda n: F.struct(n["sum"], n["start"], F.greatest(s["best"], n["sum"]).alias("best"), *ends(s, n), (s["i"] + 1).alias("i")))

    def ends(s: Column, n: Column) -> list[Column]:
        more = n["sum"] > s["best"]
        return [F.when(more, n["start"]).otherwise(s["from"]).alias("from"), F.when(more, s["i"]).otherwise(s["to"]).alias("to")]

    def of(r: Column) -> Column:
        span = r["to"] - r["from"] + 1
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))
        follows = lambda s, at: F.when(at > s["last"], F.struct((s["n"] + 1).alias("n"), at.alias("last"))).otherwise(s)
        ordered = F.aggregate(F.slice(pairs, r["from"] + 1, span), start, lambda s, p: _let(F.array_position(template, p).cast("int"), lambda at: follows(s, at)))
        return F.struct((ordered["n"] / F.greatest(span, F.lit(2))).alias("overlap"), r["from"], r["to"])

    return _let(F.aggregate(pairs, zero, step), of)


def _dot(weights: Column, offset: float, at: Column) -> Column:
    return F.aggregate(at, F.lit(offset), lambda z, i: z + F.element_at(weights, i))
