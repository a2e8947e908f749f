"""License scans by a trained paragraph classifier, with DataFrame functions alone.

A sparse logistic regression over words and word pairs gives each paragraph a probability for each
licence family and for none (`unknown`). It is fitted on the driver, on notices of the families with
words dropped and added and on a bounded sample of the corpus's paragraphs. Its temperature is set on
rows left out of the fit, other variants of the same notices. A predicted family is confirmed if the paragraph has most word pairs of
one of its notices. As no family outweighs unknown without a feature in its favour, paragraphs that
have none of the words that such features need are passed over without loss.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: Texts whose paragraphs the fit takes as ones without a licence, paragraphs of them, and words of one, at most.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, SAMPLE_WORDS = 500, 1500, 400
VARIANTS, STEPS, RATE, L1, SEED = 40, 150, 2.0, 2e-4, 42
#: Shares of a notice's words and pairs that confirm a prediction; least probability of one.
CONFIRMED, LEAST = 0.6, 0.5
UNKNOWN = "unknown"
#: Words with a larger share of the sample's paragraphs without a licence are no features, nor are pairs of them.
COMMON = 2e-4
#: Short notices of public licences, by family.
NOTICES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License.", "Licensed under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "https://creativecommons.org/licenses/by/4.0/"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "https://creativecommons.org/licenses/by-nc/4.0/"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "https://creativecommons.org/licenses/by-sa/4.0/"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal.", "This work is dedicated to the public domain."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "proprietary": ["All rights reserved.", "No part of this publication may be reproduced, stored or transmitted without prior written permission of the publisher."],
}
WORD = "[^a-z0-9]+"


def words(text: str) -> list[str]:
    return [w for w in re.split(WORD, text.lower()) if w]


def features(tokens: list[str]) -> list[str]:
    return sorted({*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:]))})


def part_of(tokens: list[str], known: set[str]) -> bool:
    """Whether the notices have most of the text's word pairs, as those of a line of a wrapped notice; of its words if it has one."""
    own = [f"{a} {b}" for a, b in zip(tokens, tokens[1:])] or tokens
    return bool(own) and 2 * sum(x in known for x in own) >= len(own)


def fitted(paragraphs: list[list[str]]) -> dict:
    """bias and weights (of each feature: for each of families, the last one unknown), gate and notices."""
    families, rng = [*NOTICES, UNKNOWN], random.Random(SEED)
    notices = {f: [words(t) for t in x] for f, x in NOTICES.items()}
    known = {x for y in notices.values() for t in y for x in features(t)}
    unknown = [p for p in paragraphs if not part_of(p, known) and all(len(set(features(p)) & set(x := features(t))) < 0.5 * len(x) for y in notices.values() for t in y)]
    pool = [w for p in unknown for w in p] or ["text"]
    often = {w for w, n in Counter(pool).items() if n > COMMON * len(pool)}
    vocabulary = {w: k for k, w in enumerate(sorted({x for y in notices.values() for t in y for x in features(t) if not set(x.split()) <= often}))}
    rows: list[tuple[list[str], int]] = []
    for k, f in enumerate(families[:-1]):
        for t in notices[f]:
            rows.append((t, k))
            for _ in range(VARIANTS):
                own = [w for w in t if rng.random() > 0.08] or t
                rows.append(([*(rng.choice(pool) for _ in range(rng.choice((0, 0, 3, 12)))), *own, *(rng.choice(pool) for _ in range(rng.choice((0, 0, 3, 12))))], k))
    scraps = sorted({w for y in notices.values() for t in y for w in t})
    rows += [(p, len(families) - 1) for p in unknown] + [([rng.choice(scraps) if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(1, 25))], len(families) - 1) for _ in range(1000)]
    rows += [([], len(families) - 1)] * 50
    rng.shuffle(rows)
    x, y = np.zeros((len(rows), len(vocabulary)), np.float32), np.array([k for _, k in rows])
    for i, (t, _) in enumerate(rows):
        x[i, [vocabulary[w] for w in features(t) if w in vocabulary]] = 1
    hot = np.eye(len(families), dtype=np.float32)[y]
    last = len(rows) * 4 // 5
    w, b = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32)
    for step in range(STEPS):
        z = x[:last] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - hot[:last]) / last
        rate = RATE * 4
        w -= rate * (x[:last].T @ g)
        b -= rate * g.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
    b[:-1] = np.minimum(b[:-1], b[-1] - 0.01)
    z = x[last:] @ w + b

    def cost(heat: float) -> float:
        v = z / heat
        return float((np.logaddexp.reduce(v, axis=1) - v[np.arange(len(v)), y[last:]]).mean())

    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=cost)
    w, b = w / heat, b / heat
    common = Counter(pool)
    helpful = [v for v, k in vocabulary.items() if (w[k, :-1] > w[k, -1]).any()]
    return {
        "families": families, "bias": [round(float(v), 6) for v in b], "weights": {v: [round(float(a), 6) for a in w[k]] for v, k in vocabulary.items() if w[k].any()},
        "gate": sorted({min(v.split(), key=lambda t: (common[t], t)) for v in helpful}), "notices": {f: [features(t) for t in x] for f, x in notices.items()},
        "longest": max(len(t) for x in notices.values() for t in x),
    }


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")


def model(docs: DataFrame) -> dict:
    """fitted() on at most SAMPLE_PARAGRAPHS distinct paragraphs of at most SAMPLE_DOCS distinct texts, chosen by hashes.

    Of a paragraph at most SAMPLE_WORDS words are taken. No texts give a model of the notices alone.
    """
    some = c.sample(docs.select("text").filter("text is not null"), SAMPLE_DOCS).select(F.explode(F.split("text", "\n")).alias("p")).distinct()
    some = some.orderBy(F.xxhash64("p"), "p").limit(SAMPLE_PARAGRAPHS)
    return fitted([r[0] for r in some.select(F.slice(tokens(F.col("p")), 1, SAMPLE_WORDS)).collect()])


#: Of stretches of lines with the same family, the nearest to a notice comes first, then the one of fewest lines.
_SPAN = "struct<lack:double,n_lines:int,first:int,last:int,probability:double,family:string>"


def _stretches(longest: int):
    """(first, last, words) of each stretch of lines that a notice of so many words can be wrapped over, from `_t`, the words of each line.

    A stretch is one line, or goes on from line to line until a line without words or until the lines after the first
    have `longest` words; a notice that starts anywhere in the first line ends within the longest stretch.
    """
    none = F.lit(0).cast("int")

    def ends(i):
        on = lambda acc, t: F.when(acc["open"] & (acc["n"] < longest) & (F.size(t) > 0), F.struct((acc["n"] + F.size(t)).alias("n"), (acc["last"] + 1).alias("last"), F.lit(True).alias("open"))).otherwise(F.struct(acc["n"].alias("n"), acc["last"].alias("last"), F.lit(False).alias("open")))
        return F.aggregate(F.slice("_t", i + 2, F.lit(longest)), F.struct(none.alias("n"), i.alias("last"), F.lit(True).alias("open")), on, lambda acc: acc["last"])

    of = lambda t, i: F.transform(F.sequence(i, ends(i)), lambda j: F.struct(i.alias("first"), j.alias("last"), F.flatten(F.slice("_t", i + 1, j - i + 1)).alias("w")))
    return F.flatten(F.transform("_t", lambda t, i: F.when(F.size(t) > 0, of(t, i)).otherwise(F.array().cast("array<struct<first:int,last:int,w:array<string>>>"))))


def _apart(spans: Column) -> Column:
    """Of sorted stretches, those that share no line with an earlier one of their family."""
    shares = lambda x: lambda y: (x["family"] == y["family"]) & (x["first"] <= y["last"]) & (y["first"] <= x["last"])
    return F.aggregate(spans, F.array().cast(f"array<{_SPAN}>"), lambda acc, x: F.when(F.exists(acc, shares(x)), acc).otherwise(F.concat(acc, F.array(x))))


def scan(docs: DataFrame, found: dict, *keep: str) -> DataFrame:
    """A row for each paragraph with a licence: the columns to keep, paragraph (the number of its first line, from 0),
    family, probability, similarity to the family's nearest notice, and confirmed.

    A paragraph is a line, or lines in a row that are nearer to a notice together than any of them is alone, as those of
    a wrapped notice are; lines without words, comment marks alone among them, part paragraphs. Lines may be part of
    paragraphs of several families; of families that are equally likely the first in order is taken. Null and empty
    texts have none with a licence; repeated rows are each scanned, and long texts are scanned whole; no rows give no
    rows. Other columns aren't read, and one to keep that is called as a new one, `_t` or `_s` gives way.
    """
    keep = c.apart(keep, "paragraph", "family", "probability", "similarity", "confirmed", "_t", "_s")
    gate = F.array(*map(F.lit, found["gate"]))
    # An explode of one value: what follows reads the value, and no filter moves below it and computes it again.
    once = lambda x: F.explode(F.array(x))
    rows = docs.select(*keep, "text").filter(F.arrays_overlap(F.split(F.lower("text"), WORD), gate))
    rows = rows.select(*keep, once(F.transform(F.split("text", "\n"), tokens)).alias("_t"))
    rows = rows.select(*keep, once(F.filter(_stretches(found["longest"]), lambda s: F.arrays_overlap(s["w"], gate))).alias("_s"))
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    rows = rows.select(*keep, once(F.transform("_s", lambda s: F.struct(s["first"], s["last"], F.array_distinct(F.concat(s["w"], pairs(s["w"]))).alias("f")))).alias("_s"))
    table = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    weights, bias, own = table(found["weights"], "map<string,array<double>>"), table(found["bias"], "array<double>"), table(sorted(found["weights"]), "array<string>")
    logits = lambda f: F.aggregate(F.transform(F.array_intersect(f, own), lambda x: weights[x]), bias, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    rows = rows.select(*keep, once(F.transform("_s", lambda s: F.struct(s["first"], s["last"], s["f"], logits(s["f"]).alias("z")))).alias("_s"))
    rows = rows.select(*keep, once(F.transform("_s", lambda s: F.struct(s["first"], s["last"], s["f"], s["z"], F.array_max(s["z"]).alias("top")))).alias("_s"))
    share = lambda s: 1 / F.aggregate(s["z"], F.lit(0.0), lambda acc, z: acc + F.exp(z - s["top"]))
    family = lambda s: F.array(*map(F.lit, found["families"]))[(F.array_position(s["z"], s["top"]) - 1).cast("int")]
    rows = rows.select(*keep, once(F.transform("_s", lambda s: F.struct(s["first"], s["last"], s["f"], family(s).alias("family"), share(s).alias("probability")))).alias("_s"))
    rows = rows.select(*keep, once(F.filter("_s", lambda s: (s["family"] != UNKNOWN) & (s["probability"] >= LEAST))).alias("_s")).filter(F.size("_s") > 0)
    notices = table(found["notices"], "map<string,array<array<string>>>")
    near = lambda s: F.array_max(F.transform(notices[s["family"]], lambda t: F.size(F.array_intersect(t, s["f"])) / F.size(t)))
    ranked = F.transform("_s", lambda s: F.struct((-near(s)).alias("lack"), (s["last"] - s["first"] + 1).alias("n_lines"), s["first"], s["last"], s["probability"], s["family"]).cast(_SPAN))
    rows = rows.select(*keep, once(F.array_sort(ranked)).alias("_s"))
    rows = rows.select(*keep, F.explode(_apart(F.col("_s"))).alias("_s"))
    similarity = -F.col("_s.lack")
    return rows.select(*keep, F.col("_s.first").alias("paragraph"), "_s.family", "_s.probability", similarity.alias("similarity"), (similarity >= CONFIRMED).alias("confirmed"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    return scan(docs, model(docs), "doc_id")
