"""Licence scans by a trained paragraph classifier, with DataFrame operations only.

Training is on the driver, in plain Python, on the fixed notices below and on
texts that are none (``OTHERS`` and shuffled notices): multinomial logistic
regression on the presence of word n-grams (1 to 3). Held-out folds set the
temperature at which its probabilities are calibrated; paragraphs without enough
evidence go to the class ``unknown``.

Scanning runs on all paragraphs of all whole texts. A paragraph without any
n-gram of the model has the bias alone and is unknown, so texts and paragraphs
without an anchor word (every n-gram of the model holds one) are left out
early. What is left is classified once per distinct paragraph: exploded n-grams
meet the table of weights, whose size the fixed notices bound, and are summed.
A family is named if the whole paragraph makes it surer than ``unknown``, the best
one first; then the n-grams of its notices are left out, and the next one must
also win on the rest by itself, until none does (a round for each family at
most). So a paragraph can name several, and a notice isn't taken for its
look-alikes too.
A named family counts if the paragraph's word pairs also cover ``COVER`` of one of the
family's notices, or notices cover as much of the paragraph.

Paragraphs are runs of lines between blank ones, so a notice may wrap; long ones
are taken in windows of ``WINDOW`` words that overlap. Words are runs of letters
a-z and digits, for anchors too. Null and empty texts have none. Equal rows are
kept, and each counts its own paragraphs.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: Notices by family, in common wording.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the 2-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public domain": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "all rights reserved": [
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved.",
    ],
}

#: Texts that share words with notices and are none.
OTHERS = [
    "The licence of the driver had expired and the office was closed.",
    "A fishing license is required in this state for any person over sixteen.",
    "The general public is free to visit the library and use the copy machine.",
    "All seats are reserved for the members of the club.",
    "Human rights of all persons are protected by the terms of the treaty.",
    "The second version of the work was published by the foundation.",
    "Apache helicopters flew over the source of the river.",
    "The students of MIT released a public report under the new terms.",
    "This program is for any person with a purpose and a free afternoon.",
    "The file was modified and the software did not start.",
    "Creative people use common tools, and attribution is a matter of manners.",
    "Redistribution of wealth is subject to the following conditions.",
    "Permission to enter was granted to the authors of the book.",
    "The domain of the function is an interval, in the public version of the text.",
    "Berkeley and Mozilla are names; the clause has a verb.",
]

#: Words that say nothing of a licence by themselves.
COMMON = (
    "0 1 2 3 4 a all and any are as associated at be by c can charge except fee file files following for form forms free in into is it later may met not of only or "
    "permitted person project provided purpose public subject terms that the this to under use v version was with without work you"
).split()

UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *NOTICES)
WINDOW, STEP = 256, 224
COVER = 0.6
#: Least calibrated probability of a family against ``unknown``.
SURE = 0.5
#: Least probability of a further family on what is left, the bias put aside.
OWN = 0.75
_word = re.compile(r"[a-z0-9]+")


def _words(text: str) -> list[str]:
    return _word.findall(text.lower())


def _ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _examples() -> list[tuple[set[str], int, int]]:
    """(n-grams, class, fold): notices alone, in other text, and cut; others; shuffled notices."""
    rng = random.Random(11)
    out = []
    filler = [w for x in OTHERS for w in _words(x)]
    for c, family in enumerate(FAMILIES):
        for notice in NOTICES.get(family, []):
            words = _words(notice)
            out.append((words, c))
            for _ in range(3):
                out.append(([*rng.sample(filler, 8), *words, *rng.sample(filler, 8)], c))
            if len(words) > 12:
                out += [(words[: len(words) * 2 // 3], c), (words[len(words) // 3 :], c)]
            for _ in range(2):
                mixed = rng.sample(words, len(words))
                out.append((rng.sample(filler, 10) + mixed[: max(1, len(mixed) // 3)], 0))
    for other in OTHERS:
        words = _words(other)
        out += [(words, 0), (rng.sample(words, len(words)), 0)]
    return [(_ngrams(w), c, i % 4) for i, (w, c) in enumerate(out)]


def _fit(rows: list[tuple[set[str], int]], epochs: int = 30, rate: float = 0.25, decay: float = 2e-4) -> tuple[dict[str, list[float]], list[float]]:
    """Stochastic gradient descent with a step per example and class."""
    k = len(FAMILIES)
    weights: dict[str, list[float]] = {}
    bias = [0.0] * k
    bias[0] = 2.0
    rng = random.Random(5)
    for epoch in range(epochs):
        step = rate / (1 + 0.1 * epoch)
        rng.shuffle(rows)
        for grams, label in rows:
            p = _softmax(_sums(weights, bias, grams), 1.0)
            for c in range(k):
                g = step * ((c == label) - p[c])
                if abs(g) < 1e-3:
                    continue
                bias[c] += 0.1 * g
                for x in grams:
                    w = weights.get(x)
                    if w is None:
                        w = weights[x] = [0.0] * k
                    w[c] += g - decay * w[c]
    return weights, bias


def _sums(weights, bias, grams) -> list[float]:
    total = list(bias)
    for x in grams:
        w = weights.get(x)
        if w:
            total = [a + b for a, b in zip(total, w)]
    return total


def _softmax(scores: list[float], heat: float) -> list[float]:
    top = max(scores)
    e = [math.exp((s - top) / heat) for s in scores]
    total = sum(e)
    return [x / total for x in e]


@lru_cache(1)
def model() -> tuple[dict[str, list[float]], list[float], float, list[str]]:
    """(weights by n-gram, bias, temperature, anchor words)."""
    rows = _examples()
    held = []
    for fold in range(4):
        weights, bias = _fit([(g, c) for g, c, f in rows if f != fold], epochs=8)
        held += [(_sums(weights, bias, g), c) for g, c, f in rows if f == fold]
    loss = lambda heat: -sum(math.log(max(1e-9, _softmax(s, heat)[c])) for s, c in held)
    heat = min((0.5 * 1.15**i for i in range(20)), key=loss)
    weights, bias = _fit([(g, c) for g, c, _ in rows])
    told = {w for some in NOTICES.values() for x in some for w in _words(x)}
    plain = ({w for x in OTHERS for w in _words(x)} - told) | set(COMMON)
    # an n-gram without a word of its own is no evidence
    kept = {x: [round(v, 4) for v in w] for x, w in weights.items() if set(x.split()) - plain and max(map(abs, w)) > 0.05}
    anchors = sorted({min(set(x.split()) - plain, key=lambda w: (-len(w), w)) for x in kept})
    return kept, bias, heat, anchors


def paragraphs(docs: DataFrame, key: str, text: str, anchors: list[str]) -> DataFrame:
    """(key, twin, parts): of rows with an anchor word, the words of every paragraph or window that holds one.

    twin tells rows of one key with different texts apart; equal rows are one.
    """
    anchor = r"(?i)(?<![a-z0-9])(?:" + "|".join(anchors) + r")(?![a-z0-9])"
    blocks = F.filter(F.split(text, r"\r?\n[ \t\r]*\n"), lambda x: x.rlike(anchor))
    some = docs.where(F.col(text).rlike(anchor)).select(F.col(key).alias("_key"), F.xxhash64(text).alias("twin"), blocks.alias("_b"))
    words = F.expr("transform(_b, x -> regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+', 0))")
    parts = F.expr(
        f"flatten(transform(_w, w -> transform(sequence(0, greatest(size(w) - {WINDOW - STEP + 1}, 0), {STEP}), i -> array_join(slice(w, i + 1, {WINDOW}), ' '))))"
    )
    held = some.withColumn("_w", words).select("_key", "twin", F.filter(parts, lambda x: x.rlike(anchor)).alias("parts"))
    return held.groupBy("_key", "twin").agg(F.first("parts").alias("parts"))


def classify(distinct: DataFrame) -> DataFrame:
    """(paragraph, family, probability, cover) of distinct rows (paragraph string): a row for each family, unknown ones left out."""
    spark = distinct.sparkSession
    weights, bias, heat, _ = model()
    told = {f: set().union(*(_ngrams(_words(x)) for x in some)) for f, some in NOTICES.items()}
    table_ = spark.createDataFrame(
        [(x, [f for f in NOTICES if x in told[f]], *w) for x, w in sorted(weights.items())],
        "gram string, owners array<string>, " + ", ".join(f"w{c} double" for c in range(len(FAMILIES))),
    )
    grams = F.expr(
        "array_distinct(flatten(transform(array(1, 2, 3), n -> CASE WHEN size(w) >= n THEN "
        "transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' ')) ELSE array() END)))"
    )
    scores = F.array(*(F.struct((F.col(f"w{c}") + F.lit(bias[c])).alias("s"), F.lit(f).alias("f"), F.lit(c).alias("c")) for c, f in enumerate(FAMILIES)))
    odds = lambda x: 1 / (1 + F.exp(-x / heat))
    left, found = distinct.select("paragraph", F.array().cast("array<string>").alias("said"), F.lit(None).cast("array<double>").alias("full")), None
    for _ in NOTICES:
        each = left.select("paragraph", "said", "full", F.split("paragraph", " ").alias("w")).select("paragraph", "said", "full", F.explode(grams).alias("gram"))
        # the fixed notices bound the table of weights
        meet = each.join(F.broadcast(table_), "gram").where(~F.arrays_overlap("said", "owners"))
        sums = meet.groupBy("paragraph").agg(F.first("said").alias("said"), F.first("full").alias("full"), *(F.sum(f"w{c}").alias(f"w{c}") for c in range(len(FAMILIES))))
        # of the first round, in which nothing is left out
        best = sums.select("paragraph", "said", scores.alias("a"), F.coalesce("full", F.transform(scores, lambda x: x["s"])).alias("full")).withColumn(
            "_b", F.expr(f"array_max(filter(a, x -> x.f <> '{UNKNOWN}' AND NOT array_contains(said, x.f) AND full[x.c] >= full[0]))")
        )
        own = odds(F.col("_b.s") - F.element_at(F.array(*map(F.lit, bias)), F.col("_b.c") + 1) - F.col("a")[0]["s"] + bias[0])
        named = best.select(
            "paragraph", "said", "full", F.col("_b.f").alias("family"), odds(F.expr("full[_b.c] - full[0]")).alias("probability"), own.alias("own")
        ).where((F.col("probability") >= SURE) & (F.col("own") >= OWN))
        named = durable(named)
        some = named.select("paragraph", "family", "probability")
        found = some if found is None else found.union(some)
        if named.limit(1).count() == 0:
            break
        left = named.select("paragraph", F.concat("said", F.array("family")).alias("said"), "full")
    pairs = lambda words: sorted(set(zip(words, words[1:])))
    notices = spark.createDataFrame(
        [(f, [" ".join(p) for p in pairs(_words(x))]) for f, some in NOTICES.items() for x in some], "family string, notice array<string>"
    )
    own = F.expr("array_distinct(transform(sequence(1, greatest(size(w) - 1, 1)), i -> array_join(slice(w, i, 2), ' ')))")
    both = found.withColumn("w", F.split("paragraph", " ")).withColumn("_own", own).join(F.broadcast(notices), "family")
    same = F.size(F.array_intersect("_own", "notice"))
    cover = F.greatest(same / F.size("notice"), same / F.greatest(F.size("_own"), F.lit(3)))
    return both.groupBy("paragraph", "family", "probability").agg(F.max(cover).alias("cover"))


def license_scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, families array, n_paragraphs, probability, confirmed) of every row.

    families: confirmed families in order; n_paragraphs and probability (the
    greatest) are of paragraphs taken for some family; confirmed: whether any is.
    """
    each = paragraphs(docs, key, text, model()[3]).select("_key", "twin", F.explode("parts").alias("paragraph"))
    found = durable(each.groupBy("_key", "twin", "paragraph").agg(F.count("*").alias("_n")))
    kinds = durable(
        classify(found.select("paragraph").distinct()).groupBy("paragraph").agg(
            F.collect_set(F.when(F.col("cover") >= COVER, F.col("family"))).alias("families"), F.max("probability").alias("probability")
        )
    )
    named = found.join(kinds, "paragraph").groupBy("_key", "twin").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))).alias("families"),
        F.sum("_n").alias("n_paragraphs"), F.max("probability").alias("probability"),
        F.max(F.size("families") > 0).alias("confirmed"),
    )
    every = docs.select(key, F.xxhash64(text).alias("_twin"))
    return every.join(named, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_twin") == F.col("twin")), "left").select(
        key, F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("families", ", ").alias("families"), "n_paragraphs", F.round("probability", 4).alias("probability"), "confirmed")
