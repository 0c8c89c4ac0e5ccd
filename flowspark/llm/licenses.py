"""Licence notices: a trained paragraph classifier, confirmed by comparison with templates."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bind, long_array

#: Names of licences, by family; each makes a template with each of ``FRAMES``.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License version 2", "GNU General Public terms", "GNU GPL v3", "GPL-3.0-or-later", "GPLv2"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v3", "LGPL-2.1-only", "LGPL"],
    "AGPL": ["GNU Affero General Public License, version 3", "AGPL-3.0", "GNU AGPL v3"],
    "BSD": ["BSD 3-Clause License", "BSD license", "BSD 2-Clause License", "BSD-3-Clause", "BSD-style license"],
    "ISC": ["ISC License", "ISC"],
    "MPL": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL-2.0"],
    "EPL": ["Eclipse Public License v2.0", "Eclipse Public License 1.0", "EPL-2.0"],
    "EUPL": ["European Union Public Licence 1.2", "European Union Public Licence v. 1.1", "EUPL-1.2"],
    "Zlib": ["zlib License", "zlib/libpng license"],
    "BSL": ["Boost Software License, Version 1.0", "BSL-1.0"],
    "Artistic": ["Artistic License 2.0", "Perl Artistic License"],
    "OFL": ["SIL Open Font License, Version 1.1", "OFL-1.1"],
    "GFDL": ["GNU Free Documentation License, Version 1.3", "GFDL"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0": ["CC0 1.0", "CC0 Universal", "CC0-1.0"],
}
FRAMES = ["Licensed under {}", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}", "This project is available under {}", "SPDX-License-Identifier: {}"]
#: Usual wordings of notices that are no frame of a name.
WORDINGS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Distributed under Apache 2.0",
    ],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "Zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"],
    "CC-BY": ["Except where otherwise noted, content is licensed under Creative Commons Attribution"],
    "CC-BY-SA": ["Text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0", "Released into the public domain under CC0 1.0"],
}
#: Sentences that use the same words without granting anything.
OTHERS = """The driver lost his licence after the second offence.
A licence fee is due every year for each television set.
The court heard a long debate on copyright and free speech.
The pilot was granted permission to land on the northern runway.
The general public was asked to stay away from the beach.
The museum is open to the public and free of charge on Sundays.
The Mozilla office moved to a new building near the river.
Apache helicopters were seen over the valley.
The MIT campus lies on the Charles River.
GNU are large antelopes of the savanna.
Their warranty covers parts and labour for two years.
Poetic license lets a writer change the order of events.
The bar applied for a liquor license from the city council.
Fishing without a license is not permitted in this lake.
Copyright law differs between countries.
Subscribe to our newsletter and share it under your own name.
The band released a new record under the old label.
Redistribution of wealth was the topic of the lecture.
The committee gave its permission and the work went on.
All rights of the workers were respected.
Creative people share a common taste for strong coffee.
The public domain of the city ends at the old wall.
He was licensed to practise medicine in three states.
The license plate of the car was covered with mud.
This work is the second part of a series on rivers.
The library is open from nine to five.
No part of the source of the river is open to visitors.
The terms of the contract were read out in public.
The spelling licence is British and license is American.
The study on warranty claims was published last year.
Mit dem Zug fuhr sie nach Hause und kam am Abend an.
Er wohnt mit seinem Bruder in einem alten Haus am Fluss.
Nicht mit mir, sagte der Wirt und schloss die Tür.
Der Garten mit den Rosen ist für alle offen.
Mit.
Elle est venue avec son frère par le train du soir.
La casa con el jardín está cerca del río.
The film was released under a new title in autumn.
The wine is distributed under the name of the old estate.
She was licensed under the old rules as a teacher.
The road runs under the bridge and along the river.
This project is a new school at the edge of the town.
The terms of the peace were harsh.
A version of the story was printed in 2004.
Except where otherwise noted, trains leave from platform two.
The source of the noise was found in the cellar.
All copies of the letter were burnt.
You may use the pool until nine in the evening.
Free of charge for any person under twelve.
To the extent possible the garden was left as it was.
The software was slow and the users complained.
The general opinion of the public was divided.
The foundation gave money for a free school.
The eclipse of the sun was seen in the whole union.
European rivers carry less water than in former years.
The artist used the common license of his trade.
Permission to use the hall was granted by the mayor.
The redistribution of land and the use of water in dry years were discussed.""".split("\n")
CLASSES = ("unknown", *NAMES)
NOT_BLANK = "[^\\x20\\x09-\\x0D]"
TOKEN = "[a-z0-9]+(?:\\.[0-9]+)*"
#: A paragraph keeps its class if the calibrated probability reaches this, else it is unknown.
MIN_PROBABILITY = 0.6
#: Shares of a template's word pairs, and of its n-grams that no other family has, that a confirmed paragraph holds.
MIN_OVERLAP = MIN_OWN = 0.5
FOLDS = 3
#: Function words; n-grams of these alone are no features.
FUNCTION_WORDS = frozenset("""a all an and any are as at be by can for from has have he her his if in into is it its may no nor not of on only or other our
 she so some such than that the their them there these they this those to two under up use was we were which will with without work you your new later less made
 mit im der die das und ist de la le en el con por para""".split())


def template_words(template: str) -> list[str]:
    return re.findall(TOKEN, template.lower())


def word_grams(words: list[str], sizes=(1, 2, 3)) -> list[str]:
    return sorted({" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)})


@functools.cache
def templates() -> dict[str, list[str]]:
    """All templates by family: names in frames, then the other wordings."""
    return {f: list(dict.fromkeys([frame.format(n) for n in names for frame in FRAMES] + WORDINGS.get(f, []))) for f, names in NAMES.items()}


@functools.cache
def template_parts() -> list[tuple[str, list[str], list[str]]]:
    """(family, word pairs, n-grams of its own) of each template, for confirmation; templates of equal parts once. Pairs of function words are left out.

    An n-gram is the family's own if no other family's template holds it. Of the own ones only the
    shortest count: ``lesser``, not ``gnu lesser``.
    """
    holds: dict[str, set[str]] = {}
    for family, texts in templates().items():
        for text in texts:
            for gram in word_grams(template_words(text)):
                holds.setdefault(gram, set()).add(family)
    found = {}
    for family, texts in templates().items():
        for text in texts:
            own = [g for g in word_grams(template_words(text)) if holds[g] == {family}]
            least = min((g.count(" ") for g in own), default=0)
            own = tuple(g for g in own if g.count(" ") == least)
            pairs = tuple(p for p in word_grams(template_words(text), (2,)) if not FUNCTION_WORDS.issuperset(p.split())) or tuple(word_grams(template_words(text), (1,)))
            found[family, pairs, own] = (family, list(pairs), list(own))
    return list(found.values())


#: A wrapped notice has a word of its own in each line, so no more lines than the longest template has words.
MOST_LINES = max(len(t.split()) for ts in templates().values() for t in ts)


def notice_words(paragraph: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and dots inside numbers."""
    return F.regexp_extract_all(ascii_lower(paragraph), F.lit(TOKEN), F.lit(0))


def grams_of(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def all_grams(words: Column) -> Column:
    """The distinct word 1-, 2- and 3-grams."""
    return F.array_distinct(F.concat(words, grams_of(words, 2), grams_of(words, 3)))


def training_rows() -> list[tuple[str, int, int]]:
    """(paragraph, label, group): each template and unrelated sentence whole and with others around it, wordings without a name of the licence also in halves and with words left out.

    Line breaks and comment marks are no words, so wrapped copies have the features of the
    unwrapped. Rows made from one text share a group.
    """
    rows, wordings = [], {t for ts in WORDINGS.values() for t in ts}
    texts = [(t, CLASSES.index(f)) for f, ts in templates().items() for t in ts] + [(t, 0) for t in OTHERS]
    for group, (text, label) in enumerate(texts):
        words = text.split()
        rows.append((text, label, group))
        for i in range(3 if text in wordings or not label else 0):
            drop = int(hashlib.md5(f"{i}:{text}".encode()).hexdigest(), 16) % len(words)
            rows.append((" ".join(words[:drop] + words[drop + 1 :]), label, group))
            half = words[: len(words) // 2] if i % 2 else words[len(words) // 2 :]
            rows.append((" ".join(half) if len(words) > 12 else text, label, group))
        rows.append((f"Copyright 2020 the authors. {text}" if label else f"On Monday {text}", label, group))
        if label:  # a notice inside a longer paragraph
            i = int(hashlib.md5(text.encode()).hexdigest(), 16)
            rows.append((f"{OTHERS[i % len(OTHERS)]} {text} {OTHERS[i // 99 % len(OTHERS)]}", label, group))
    for i in range(240):  # paragraphs of some length that grant nothing, and empty ones
        order = sorted(OTHERS, key=lambda t: hashlib.md5(f"{i}:{t}".encode()).hexdigest())
        rows.append((" ".join(order[: i % 8]), 0, -1 - i))
    return rows


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit_sparse(x: np.ndarray, y: np.ndarray, weight: np.ndarray, lasso: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted multinomial logistic regression with an L1 penalty, by accelerated proximal gradient."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    share = (weight / weight.sum()).astype(np.float32)[:, None]
    direction = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest curvature, by power iteration
        direction = x.T @ (share[:, 0] * (x @ direction))
        curvature = float(np.linalg.norm(direction))
        direction /= max(curvature, 1e-12)
    ahead, ahead_b, momentum, rate = w, b, 1.0, np.float32(2 / max(curvature + 1, 1e-6))
    for _ in range(steps):
        error = (softmax(x @ ahead + ahead_b) - y) * share
        new, new_b = ahead - rate * (x.T @ error), ahead_b - rate * error.sum(0)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * np.float32(lasso), 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        push = np.float32((momentum - 1) / following)
        ahead, ahead_b = new + push * (new - w), new_b + push * (new_b - b)
        w, b, momentum = new, new_b, following
    return w, b


@functools.cache
def default_model():
    return fit_license_model(training_rows())


def fit_license_model(labelled: list[tuple[str, int, int]], max_rows: int = 5000, steps: int = 120, lasso: float = 2e-4, unknown_share: float = 0.75) -> tuple[list[str], list[list[int]], list[int]]:
    """N-grams with a weight, weights (class x n-gram) and biases, in thousandths, of sparse multinomial logistic regression on at most ``max_rows`` rows.

    Probabilities are calibrated on texts that their model has not seen: each of ``FOLDS`` models
    judges the groups left out of its fit, and the temperature and the shift of the unknown class
    that make the log loss of these judgements least go into the weights of the model of all rows.
    Rows count so that ``unknown_share`` of all weight is the unknown class's, and the families
    weigh the same among themselves. An n-gram of one text alone is no
    feature, but for words and pairs of ``WORDINGS``.
    """
    rows = labelled[:max_rows]
    grams = [word_grams(template_words(t)) for t, _, _ in rows]
    count: dict[str, set] = {}
    for found, (_, _, group) in zip(grams, rows, strict=True):
        for g in found:
            count.setdefault(g, set()).add(group)
    wordings = {g for ts in WORDINGS.values() for t in ts for g in word_grams(template_words(t))}
    count = {g: groups for g, groups in count.items() if not FUNCTION_WORDS.issuperset(g.split())}
    vocabulary = sorted(g for g, groups in count.items() if len(groups) > 1 or (g in wordings and g.count(" ") < 2))
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, found in enumerate(grams):
        x[i, [at[g] for g in found if g in at]] = 1
    y = np.eye(len(CLASSES), dtype=np.float32)[[label for _, label, _ in rows]]
    size = y.sum(0)
    each = np.where(size > 0, np.array([unknown_share] + [(1 - unknown_share) / max(1, (size[1:] > 0).sum())] * (len(size) - 1)) / np.maximum(size, 1), 0)
    weight = y @ each
    fold = np.array([group % FOLDS for _, _, group in rows])
    unseen = np.zeros_like(y)
    for f in range(FOLDS):
        w, b = fit_sparse(x[fold != f], y[fold != f], weight[fold != f], lasso, steps)
        unseen[fold == f] = x[fold == f] @ w + b
    unknown = np.eye(len(CLASSES))[0]
    loss = lambda t, s: -np.log(np.maximum((softmax(unseen / t + s * unknown) * y).sum(1), 1e-12)) @ weight / weight.sum()
    temperature, shift = min(((t, s) for t in np.geomspace(0.2, 5, 25) for s in np.linspace(-3, 3, 25)), key=lambda v: loss(*v))
    w, b = fit_sparse(x, y, weight, lasso, steps)
    w, b = w / temperature, b / temperature + shift * unknown
    kept = np.flatnonzero(np.abs(w).max(1) > 5e-4)
    return [vocabulary[i] for i in kept], [[int(round(float(v) * 1e3)) for v in w[kept, c]] for c in range(len(CLASSES))], [int(round(float(v) * 1e3)) for v in b]


def evidence(model) -> str | None:
    """A pattern that each text matches which the model may not call unknown.

    A family needs a certain gain on unknown to reach the least probability. Of the n-grams that
    speak for it, a set that gives less than that all together cannot do it without any of the
    others; the pattern finds the others of all families. That holds for any such set: words of
    one or two characters, which are frequent anywhere, go in first, then those of the smallest gains. N-grams that
    hold another listed one are left out. None if the biases alone may do it; then every text is judged.
    """
    vocabulary, weights, biases = model
    speaks = set()
    for w, b in zip(weights[1:], biases[1:], strict=True):
        need = 1e3 * np.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY)) + biases[0] - b
        if need <= 0:
            return None
        gains = sorted((len(g) > 2, w[i] - weights[0][i], g) for i, g in enumerate(vocabulary) if w[i] > weights[0][i])
        total = np.cumsum([x for _, x, _ in gains])
        speaks |= {g for (_, _, g), t in zip(gains, total, strict=True) if t >= need}
    inner = lambda g: [x for x in word_grams(g.split()) if x != g]
    least = sorted(g for g in speaks if not any(x in speaks for x in inner(g)))
    by_word: dict[str, list[str]] = {}
    for g in least:
        first, _, rest = g.partition(" ")
        by_word.setdefault(first, []).append(rest)
    gap = "[^a-z0-9]+"
    parts: dict[str, list[str]] = {}
    for first, rests in by_word.items():
        follow = "" if "" in rests else gap + "(?:" + "|".join(gap.join(map(re.escape, r.split())) for r in rests) + ")"
        parts.setdefault(first[0], []).append(re.escape(first[1:]) + follow)
    return "(?i)(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(p)})" for c, p in sorted(parts.items())) + ")(?![a-z0-9])"


def class_scores(grams: Column, model) -> Column:
    """Array of each class's bias and summed weights of ``grams``, as many classes summed in one long as fit without overflow."""
    vocabulary, weights, biases = model
    bits = max(sum(map(abs, w)) + abs(b) for w, b in zip(weights, biases, strict=True)).bit_length() + 1
    half, per = 1 << (bits - 1), max(1, 63 // bits)
    packed = lambda values: sum(v << (bits * j) for j, v in enumerate(values))
    groups = [range(c, min(c + per, len(biases))) for c in range(0, len(biases), per)]
    table = lambda g: long_array([packed([weights[c][i] for c in g]) for i in range(len(vocabulary))])
    words = F.split(F.lit("\n".join(vocabulary)), "\n")
    total = lambda at, g: F.aggregate(at, F.lit(packed([biases[c] for c in g])).cast("long"), lambda acc, i: acc + F.element_at(table(g), i))

    def unpacked(totals: Column) -> Column:
        out = []
        for k, g in enumerate(groups):
            rest = totals[k]
            for _ in g:
                out.append(((rest + half).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) - half) / F.lit(1000.0))
                rest = F.shiftright(rest + half, bits)
        return F.array(*out)

    known = F.transform(F.array_intersect(grams, words), lambda g: F.array_position(words, g).cast("int"))
    return bind(bind(known, lambda at: F.array(*[total(at, g) for g in groups])), unpacked)


def judge_paragraph(paragraph: Column, model) -> Column:
    """Struct (family, probability, overlap, confirmed) of one paragraph."""
    empty = F.struct(F.lit("unknown").alias("family"), F.lit(0.0).alias("overlap"), F.lit(False).alias("confirmed"))

    def of(scores: Column) -> Column:
        top = F.array_max(scores)
        chance = F.lit(1.0) / F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
        best = F.array_position(scores, top).cast("int")
        family = F.when(chance >= MIN_PROBABILITY, F.element_at(F.array(*map(F.lit, CLASSES)), best)).otherwise(F.lit("unknown"))
        return F.struct(family.alias("family"), F.round(chance, 4).alias("probability"))

    def with_template(grams: Column) -> Column:
        def compared(found: Column) -> Column:
            match = F.when(found["family"] == "unknown", empty).otherwise(best_template(grams, found["family"]))
            return bind(match, lambda m: F.struct(found["family"].alias("family"), found["probability"].alias("probability"), m["overlap"].alias("overlap"), m["confirmed"].alias("confirmed")))

        return bind(bind(class_scores(grams, model), of), compared)

    return bind(bind(notice_words(paragraph), all_grams), with_template)


@functools.cache
def template_text() -> str:
    return "\n".join(";".join([f, "|".join(pairs), "|".join(own)]) for f, pairs, own in template_parts())


def template_table() -> Column:
    """Array of all templates as texts ``family;pairs;own``, folded to one literal."""
    return F.split(F.lit(template_text()), "\n")


def part(template: Column, number: int) -> Column:
    text = F.split_part(template, F.lit(";"), F.lit(number))
    return F.filter(F.split(text, "\\|"), lambda x: x != "")


def share(grams: Column, part: Column) -> Column:
    return bind(part, lambda p: F.size(F.array_intersect(grams, p)) / F.greatest(F.size(p), F.lit(1)).cast("double"))


def best_template(grams: Column, family: Column) -> Column:
    """Struct (family, overlap, confirmed) of the family's template that the grams hold most of; confirmed ones first."""

    def compared(t: Column) -> Column:
        shares = F.struct(share(grams, part(t, 2)).alias("pairs"), share(grams, part(t, 3)).alias("own"))
        return bind(shares, lambda s: F.struct(((s["pairs"] >= MIN_OVERLAP) & (s["own"] >= MIN_OWN)).alias("confirmed"), F.round(s["pairs"], 4).alias("overlap")))

    best = F.array_max(F.transform(F.filter(template_table(), lambda t: F.split_part(t, F.lit(";"), F.lit(1)) == family), compared))
    return bind(best, lambda b: F.struct(family.alias("family"), b["overlap"].alias("overlap"), b["confirmed"].alias("confirmed")))


def template_pairs(words: Column) -> Column:
    """The word pairs that some template has."""
    return F.array_intersect(grams_of(words, 2), F.split(F.lit("|".join(sorted({p for _, ps, _ in template_parts() for p in ps}))), "\\|"))


def holds_template(pairs: Column) -> Column:
    """Whether the pairs have the share of some template's word pairs that confirms a notice."""
    return bind(pairs, lambda g: (F.size(g) > 1) & F.exists(template_table(), lambda t: share(g, part(t, 2)) >= MIN_OVERLAP))


def wrapped_notices(lines: Column, model) -> Column:
    """Confirmed notices that reach over several consecutive non-blank lines, as structs (line, last, family, probability, overlap, confirmed).

    Windows of 2 to ``MOST_LINES`` lines that hold enough of a template's word pairs to confirm it,
    with a template's pair in or at the end of their first line and in or at the start of their
    last, are judged as one paragraph each; of overlapping windows of one family the most probable
    stays (ties: the shorter, then the earlier). A window without those pairs cannot be confirmed.
    """
    empty = F.array().cast("array<struct<line:int,last:int,family:string,probability:double,overlap:double,confirmed:boolean>>")

    def told(words: Column) -> Column:
        """For each line its template pairs with the word after it, and whether it has one with the word before it."""
        after = lambda w, i: template_pairs(F.concat(w, F.slice(F.coalesce(F.get(words, i + 1), F.array().cast("array<string>")), 1, 1)))
        before = lambda w, i: template_pairs(F.concat(F.when(i > 0, F.slice(F.reverse(F.coalesce(F.get(words, i - 1), F.array().cast("array<string>"))), 1, 1)).otherwise(F.array().cast("array<string>")), w))
        return F.transform(words, lambda w, i: F.struct(after(w, i).alias("pairs"), (F.size(before(w, i)) > 0).alias("ends")))

    def of(each: Column) -> Column:
        within = lambda i, n: F.flatten(F.transform(F.slice(each, i + 1, n), lambda x: x["pairs"]))
        solid = lambda i, n: ~F.exists(F.slice(lines, i + 1, n), lambda x: ~x.rlike(NOT_BLANK))
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 2), lambda i: F.size(F.get(each, i)["pairs"]) > 0)

        def windows(i: Column) -> Column:
            most = F.least(F.lit(MOST_LINES), F.size(lines) - i)
            ends = lambda n: F.get(each, i + n - 1)["ends"] & solid(i, n) & holds_template(within(i, n))
            put = lambda n, j: F.struct(i.alias("line"), (i + n - 1).alias("last"), j["family"].alias("family"), j["probability"].alias("probability"), j["overlap"].alias("overlap"), j["confirmed"].alias("confirmed"))
            judged = lambda n: bind(judge_paragraph(F.concat_ws("\n", F.slice(lines, i + 1, n)), model), lambda j: put(n, j))
            return F.filter(F.transform(F.filter(F.sequence(F.lit(2), most), ends), judged), lambda w: w["confirmed"] & (w["family"] != "unknown"))

        ranked = F.array_sort(F.transform(F.flatten(F.transform(starts, windows)), lambda w: F.struct((-w["probability"]).alias("p"), (w["last"] - w["line"]).alias("n"), w["line"].alias("l"), w.alias("w"))))
        overlaps = lambda a, w: (a["family"] == w["family"]) & (a["line"] <= w["last"]) & (w["line"] <= a["last"])
        return F.aggregate(ranked, empty, lambda acc, r: F.when(F.exists(acc, lambda a: overlaps(a, r["w"])), acc).otherwise(F.concat(acc, F.array(r["w"]))))

    def if_held(each: Column) -> Column:
        return F.when(holds_template(F.flatten(F.transform(each, lambda x: x["pairs"]))), of(each)).otherwise(empty)

    return F.when(F.size(lines) > 1, bind(bind(F.transform(lines, notice_words), told), if_held)).otherwise(empty)


def scan_licenses(docs: DataFrame, model) -> DataFrame:
    """doc_id, n_paragraphs, notices, n_notices, license and families for every row of ``docs``.

    Paragraphs are the \\n-separated lines that are not blank; every one is judged, and so are
    notices wrapped over several lines (``wrapped_notices``). notices lists (line, family,
    probability, overlap, confirmed) of paragraphs whose class is a licence family; a wrapped
    notice stands at its first line, in place of its lines' own unconfirmed notices, and is left
    out if one of its lines is confirmed for the same family. license is the family of the
    confirmed notice of highest probability (ties: the earlier line), or ``unconfirmed`` if there
    are only others, else null. Null or empty text has no paragraph. Repeated rows are judged
    alike, an empty table gives none, only doc_id and text are read, and nothing is shuffled.
    """
    pattern = evidence(model)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")

    def row(x: Column, i: Column) -> Column:
        def put(j: Column) -> Column:
            return F.struct(i.alias("line"), i.alias("last"), j["family"].alias("family"), j["probability"].alias("probability"), j["overlap"].alias("overlap"), j["confirmed"].alias("confirmed"))

        return F.when(x.rlike(pattern or NOT_BLANK), bind(judge_paragraph(x, model), put))

    def together(both: Column) -> Column:
        inside = lambda x, w: (x["line"] >= w["line"]) & (x["last"] <= w["last"])
        same = lambda x, w: inside(x, w) & (x["family"] == w["family"])
        wrapped = F.filter(both["w"], lambda w: ~F.exists(both["s"], lambda x: same(x, w) & x["confirmed"]))

        def merged(kept: Column) -> Column:
            single = F.filter(both["s"], lambda x: x["confirmed"] | ~F.exists(kept, lambda w: inside(x, w)))
            return F.transform(F.array_sort(F.concat(single, kept)), lambda n: n.dropFields("last"))

        return bind(wrapped, merged)

    def notices_of(each: Column) -> Column:
        single = F.filter(F.transform(each, row), lambda n: F.coalesce(n["family"] != "unknown", F.lit(False)))
        return bind(F.struct(single.alias("s"), wrapped_notices(each, model).alias("w")), together)

    none = F.array().cast("array<struct<line:int,family:string,probability:double,overlap:double,confirmed:boolean>>")
    notices = F.when(text.rlike(pattern or NOT_BLANK), bind(lines, notices_of)).otherwise(none)
    paragraphs = F.size(F.filter(lines, lambda x: x.rlike(NOT_BLANK))).cast("long")
    # Not deterministic to the optimizer: else the notices would be worked out anew at each use.
    found = docs.select("doc_id", paragraphs.alias("n_paragraphs"), F.when(F.monotonically_increasing_id() >= 0, notices).alias("notices"))
    best = F.array_max(F.transform(F.filter("notices", lambda n: n["confirmed"]), lambda n: F.struct(n["probability"].alias("p"), (-n["line"]).alias("l"), n["family"].alias("f"))))
    license = F.coalesce(best["f"], F.when(F.size("notices") > 0, F.lit("unconfirmed")))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"]))), ",")
    return found.select("doc_id", "n_paragraphs", "notices", F.size("notices").cast("long").alias("n_notices"), license.alias("license"), families.alias("families"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
    shown = F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["line"].cast("string"), n["family"], n["probability"].cast("string"), n["confirmed"].cast("string"))), ",")
    return found.select("doc_id", "n_paragraphs", "n_notices", "license", "families", shown.alias("notices"))
