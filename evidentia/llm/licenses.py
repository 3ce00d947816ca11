"""License scans: a paragraph classifier with template comparison, in DataFrame functions only."""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column

#: Notices of each family, as they are commonly printed (fixed values).
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License",
        "Released under the Apache License, Version 2.0.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GNU General Public License, version 3.",
        "Licensed under the GPL.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under the CC BY-SA 4.0 license.",
        "Licensed under CC BY 4.0.",
    ],
    "proprietary": ["All rights reserved.", "Copyright (c) all rights reserved, no part may be reproduced without permission"],
}
#: Paragraphs of the licences themselves, that the classifier learns from beside the notices (fixed values).
PARAGRAPHS = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is Incompatible With Secondary Licenses, as defined by the Mozilla Public License, v. 2.0.",
    ],
    "cc": [
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "You are free to share, copy and redistribute the material in any medium or format under the following terms: you must give appropriate credit, provide a link to the license, and indicate if changes were made.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This document is confidential and proprietary; unauthorized copying, disclosure or distribution is strictly prohibited.",
    ],
}
#: Paragraphs of no family, in ordinary words that notices use too (fixed values).
OTHERS = [
    "the driver renewed a license for the car", "the license plate was taken from the road", "permission to leave was granted to the guest",
    "a copy of the letter was sent to the office", "the software was tested by the team", "the terms of the game are known to all",
    "this version of the story is the second", "public works were opened in the town", "he was released under the bridge", "source of the river and its form",
    "the file was opened and the program began to run in the hope that it will be useful", "her fishing licence expired, so she applied for a new one", "the above list is included in all copies of the report",
    "no part of the house was open to the public", "rights and duties of persons are the subject of the book", "the warranty on the car covers any kind of damage",
]
#: Paragraphs of the corpus that the classifier learns as unknown are drawn among those without any of these words.
ANCHOR = r"(?i)licen[sc]|permission|redistribut|rights reserved|warrant|\bgpl\b|\bgnu\b|creative commons|\bcc by|mozilla"
#: About so many paragraphs of the corpus are drawn (a sample by hash, whatever the corpus).
UNKNOWN_ROWS = 2000
#: Calibrated probability below which a paragraph is unknown, and containment that confirms a likely family.
MIN_PROBABILITY = 0.5
MIN_OVERLAP = 0.5
EPOCHS = 150
#: Variants of each paragraph of a licence to learn from; one in four calibrates.
VARIANTS = 24
#: Grams in more than this share of the corpus's unknown paragraphs, or of such words only, say nothing and have no weight.
MAX_SHARE = 0.005
#: Windows of so many words are scored inside a paragraph; the longest holds any template.
SIZES = (5, 8, 12, 24)
#: A window reaches into so many lines behind its own at most.
LATER = 4


def _words_of(text: str) -> list[str]:
    return [w for w in (w.strip(".") for w in re.findall(r"[a-z0-9.]+", text.lower().replace(",", " "))) if w]


def _grams_of(words: list[str]) -> list[str]:
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def _grams(text: str) -> list[str]:
    return _grams_of(_words_of(text))


class Model:
    """For each family the weights of its licences' word 1- and 2-grams, a bias, and Platt's two numbers."""

    def __init__(self, grams: list[str], families: list[str], w: np.ndarray, bias: np.ndarray, slope: np.ndarray, shift: np.ndarray) -> None:
        self.grams, self.families, self.w, self.bias, self.slope, self.shift = grams, families, w, bias, slope, shift

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """A row a text, a column a family; for tests and calibration."""
        return _sigmoid(self.slope * self.scores([_words_of(t) for t in texts]) + self.shift)

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        at = {g: i for i, g in enumerate(self.grams)}
        out = np.zeros((len(rows), len(self.families)))
        for k, words in enumerate(rows):
            g = _grams_of(words)
            out[k] = self.bias + self.w[[at[x] for x in g if x in at]].sum(axis=0) / np.sqrt(max(1, len(g)))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def vocabulary() -> set[str]:
    return {w for f, ts in TEMPLATES.items() for t in [*ts, *PARAGRAPHS[f]] for w in _words_of(t)}


def labelled(unknown: list[str], seed: int = 1) -> list[tuple[str, list[str]]]:
    """(family or "", words) to learn from: notices and paragraphs of licences whole, in windows, with words lost and with foreign words around; and paragraphs of no licence."""
    rng = np.random.default_rng(seed)
    foreign = [w for t in [*OTHERS, *unknown] for w in _words_of(t)] or ["x"]
    rows: list[tuple[str, list[str]]] = []
    for family, texts in TEMPLATES.items():
        for text in [*texts, *PARAGRAPHS[family]]:
            words = _words_of(text)
            for k in range(VARIANTS):
                part = words
                if k and len(words) > 8 and rng.random() < 0.5:
                    start = int(rng.integers(0, len(words) - 7))
                    part = words[start : start + int(rng.integers(8, 25))]
                if k and rng.random() < 0.4:
                    part = [w for w in part if rng.random() > 0.15] or part
                if k and rng.random() < 0.4:
                    n = int(rng.integers(1, 5))
                    part = [foreign[i] for i in rng.integers(0, len(foreign), n)] + part
                rows.append((family, part))
    for text in [*OTHERS, *unknown]:
        words = _words_of(text)
        rows.append(("", words[:24]))
        if len(words) > 12:  # a window, as lines are scored by windows too
            rows.append(("", words[5:13]))
    for _ in range(len(OTHERS) * 20):  # ordinary words that notices use too, in any mixture
        mixed = [w for i in rng.integers(0, len(OTHERS), 3) for w in _words_of(OTHERS[i])]
        rows.append(("", list(rng.permutation(mixed))[: int(rng.integers(5, 25))]))
    own = vocabulary()
    shared = [w for w in foreign if w in own]
    for _ in range(len(unknown)):  # those of them that the corpus uses, as often as it does
        rows.append(("", [shared[i] for i in rng.integers(0, len(shared), int(rng.integers(5, 25)))]))
    return rows


@functools.lru_cache(maxsize=4)
def train(unknown: tuple[str, ...] = ()) -> Model:
    """One-against-rest logistic regressions, fitted on three quarters of labelled() and calibrated on the rest.

    The rows are a bounded number on the driver, most of them made from fixed texts.
    """
    rows = labelled(list(unknown))
    families = sorted(TEMPLATES)
    grams = sorted({g for f, ts in TEMPLATES.items() for t in [*ts, *PARAGRAPHS[f]] for g in _grams(t)})
    at = {g: i for i, g in enumerate(grams)}
    seen: dict[str, int] = {}
    for t in unknown:
        for g in _grams(t):
            seen[g] = seen.get(g, 0) + 1
    often = lambda g: seen.get(g, 0) > MAX_SHARE * len(unknown)
    plain = {g for g in grams if often(g) or all(map(often, g.split()))}
    i, j, x = [], [], []
    for k, (_, words) in enumerate(rows):
        g = _grams_of(words)
        for c in (at[y] for y in g if y in at and y not in plain):
            i.append(k)
            j.append(c)
            x.append(1 / np.sqrt(len(g)))
    i, j, x = np.array(i), np.array(j), np.array(x)
    check = np.arange(len(rows)) % 4 == 3
    m = len(families)
    w, bias, slope, shift = np.zeros((len(grams), m)), np.zeros(m), np.ones(m), np.zeros(m)
    for c, family in enumerate(families):
        y = np.array([f == family for f, _ in rows], float)
        weight = np.where(check, 0.0, np.where(y == 1, 0.5 / y[~check].sum(), 0.5 / (1 - y)[~check].sum()))
        v, b, m1, m2, b1, b2 = np.zeros(len(grams)), 0.0, np.zeros(len(grams)), np.zeros(len(grams)), 0.0, 0.0
        for t in range(1, EPOCHS + 1):
            d = weight * (_sigmoid(np.bincount(i, x * v[j], len(rows)) + b) - y)
            g, gb = np.bincount(j, x * d[i], len(grams)) + 1e-5 * v, d.sum()
            m1, m2, b1, b2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g, 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
            v -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
            b -= 0.1 * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.999**t)) + 1e-9)
        z = np.bincount(i, x * v[j], len(rows)) + b
        w[:, c], bias[c] = v, b
        slope[c], shift[c] = _platt(z[check], y[check])
    return Model(grams, families, w, bias, slope, shift)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn scores into probabilities, by Newton steps on smoothed targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    f, ab = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(f @ ab)
        step = np.linalg.solve(f.T @ (f * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), f.T @ (t - p) - 1e-3 * (ab - [1.0, 0.0]))
        ab = ab + np.clip(step, -1, 1)
    return (float(ab[0]), float(ab[1])) if ab[0] > 0 else (1.0, 0.0)


def sample(docs: DataFrame, text: str = "text", rows: int = UNKNOWN_ROWS) -> tuple[str, ...]:
    """About rows paragraphs of the corpus without a word of notices, drawn by a hash of the paragraph: what unknown looks like here."""
    lines = docs.select(F.explode(F.split(column(text), "\n")).alias("line")).filter(F.col("line").rlike("[A-Za-z]") & ~F.col("line").rlike(ANCHOR))
    n = lines.count()
    place = F.pmod(F.xxhash64(F.lit("licence sample"), "line"), F.lit(1_000_000))
    drawn = lines.filter(place < max(1, int(1_000_000 * min(1.0, rows / max(1, n))))).select(F.substring("line", 1, 400).alias("line")).distinct()
    return tuple(sorted(r["line"] for r in drawn.collect()))


def _sql_words(line: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(F.lower(F.replace(line, F.lit(","), F.lit(" "))), F.lit("[a-z0-9.]+"), 0), lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def _starts(words: Column, own: Column, known: list[str]) -> Column:
    """(start, size) of the paragraph itself, and of the windows of each of SIZES that begin with one of the known words of it (own words; the rest is what follows)."""
    n = F.size(words)
    first = F.filter(F.transform(words, lambda w, i: F.when((i < own) & w.isin(known), i)), lambda i: i.isNotNull())
    inside = F.flatten(F.transform(first, lambda i: F.array(*[F.struct(i.alias("start"), F.least(F.lit(k), n - i).alias("size")) for k in SIZES])))
    return F.array_distinct(F.concat(F.array(F.struct(F.lit(0).alias("start"), own.alias("size"))), inside))


def _sql_grams(words: Column) -> Column:
    pairs = F.when(F.size(words) > 1, F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(words[i], F.lit(" "), w))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """key, line, family, probability, overlap, confirmed for each paragraph that may hold a notice.

    Paragraphs are lines, each with the words that follow it as far as the longest
    window reaches, so a notice wrapped over lines is whole at the line where it
    begins. They are scored whole and by windows of fixed sizes, of which the best
    counts, so words around a notice don't dilute it. family is the likeliest one, or
    `unknown` where its calibrated probability stays under 0.5 and no window holds a whole
    template; confirmed says that a window holds at least half of the words
    and word pairs of one of the family's templates.

    All paragraphs are looked at. One gives a row if it holds a word without which
    no paragraph can reach a probability of 0.5 or hold a whole template, as follows from the
    weights (see telling): nothing is lost by leaving the others out. Null and empty texts
    give no row; rows that repeat a key, or have none, are told apart. Weights (a
    few thousand) and templates are constants of fixed size.
    """
    spark = docs.sparkSession
    unknown = () if model else sample(docs, text)
    model = model or train(unknown)
    longest = max(SIZES)
    lines = F.split(column(text), "\n")
    with_next = F.transform(lines, lambda x, i: F.struct(x.alias("own"), F.substring(F.array_join(F.slice(lines, i + 2, F.lit(LATER)), " "), 1, 20 * longest).alias("next")))
    # the number belongs to the row, so it stands before the lines are taken apart
    rows = docs.select(column(key).alias("key"), F.monotonically_increasing_id().alias("doc"), with_next.alias("lines"))
    rows = rows.select("key", "doc", F.posexplode("lines").alias("line", "p")).select("key", "doc", "line", "p.own", "p.next")
    # words as _sql_words sees them, without lambdas, and only of lines that have one of the telling words
    strong = F.broadcast(spark.createDataFrame([(w,) for w in telling(model, unknown)], "word string"))
    each = rows.withColumn("word", F.explode(F.split(F.lower("own"), "[^a-z0-9.]+"))).withColumn("word", F.btrim("word", F.lit(".")))
    found = each.join(strong, "word", "left_semi").groupBy("key", "doc", "line").agg(F.first("own").alias("own"), F.first("next").alias("next"))
    parts = found.select("key", "doc", "line", _sql_words(F.col("own")).alias("mine"), F.slice(_sql_words(F.col("next")), 1, longest).alias("after"))
    parts = parts.select("key", "doc", "line", F.size("mine").alias("n_own"), F.concat("mine", "after").alias("words"))
    return _scored(spark, parts, model).withColumnRenamed("key", key)


def telling(model: Model, unknown: tuple[str, ...] = ()) -> list[str]:
    """Known words of which every notice holds one; the others can stand in any text.

    The others are taken commonest first (by unknown, then by their part in the
    weights) as long as no window of theirs alone can lift a family to a probability of 0.5,
    and as long as no template consists of them alone. m known grams add at most the
    sum of the m largest weights, and the window has m grams at least, so no window
    scores more than the largest such sum over the root of m.
    """
    need = -(model.shift / model.slope + model.bias)
    lift = np.maximum(0.0, model.w)
    common: dict[str, int] = {}
    for t in [*OTHERS, *unknown]:
        for w in {*_words_of(t)}:
            common[w] = common.get(w, 0) + 1
    of_word: dict[str, list[int]] = {}
    for k, g in enumerate(model.grams):
        for w in {*g.split()}:
            of_word.setdefault(w, []).append(k)
    templates = [{*_words_of(t)} for ts in TEMPLATES.values() for t in ts]
    weak: set[str] = set()
    held: list[int] = []
    root = np.sqrt(np.arange(1, len(model.grams) + 1))
    for w in sorted(of_word, key=lambda w: (-common.get(w, 0), lift[of_word[w]].max(axis=1).sum(), w)):
        more = held + [k for k in of_word[w] if {*model.grams[k].split()} <= weak | {w}]
        top = (-np.sort(-lift[more], axis=0)).cumsum(axis=0) / root[: len(more), None] if more else np.zeros((1, len(need)))
        if (top.max(axis=0) < need).all() and not any(t <= weak | {w} for t in templates):
            weak.add(w)
            held = more
    return sorted(of_word.keys() - weak)


def _scored(spark: SparkSession, parts: DataFrame, model: Model) -> DataFrame:
    """key, line, family, probability, overlap, confirmed of parts: the best window of each."""
    families = model.families
    # windows begin with a word that has a weight or begins a template
    known = sorted({g for k, g in enumerate(model.grams) if " " not in g and model.w[k].any()} | {_words_of(t)[0] for ts in TEMPLATES.values() for t in ts})
    lines = parts.withColumn("at", F.explode(_starts(F.col("words"), F.col("n_own"), known)))
    lines = lines.select("key", "doc", "line", "n_own", "at", _sql_grams(F.slice("words", F.col("at.start") + 1, F.col("at.size"))).alias("g"))
    table = F.broadcast(spark.createDataFrame([(g, [float(x) for x in model.w[k]]) for k, g in enumerate(model.grams)], "gram string, w array<double>"))
    # each gram of a window once; sums by window are partial before the shuffle
    each = lines.select("key", "doc", "line", "n_own", "at", F.size("g").alias("n"), F.explode("g").alias("gram")).join(table, "gram")
    sums = [F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(families))]
    hits = [F.count_if(F.col("gram").isin(_grams(t))).alias(f"t{i}_{j}") for i, f in enumerate(families) for j, t in enumerate(TEMPLATES[f])]
    per = each.groupBy("key", "doc", "line", "n_own", "at", "n").agg(*sums, *hits)
    z = lambda i: float(model.bias[i]) + F.col(f"s{i}") / F.sqrt("n")
    p = lambda i: 1 / (1 + F.exp(-(float(model.slope[i]) * z(i) + float(model.shift[i]))))
    over = lambda i: F.greatest(F.lit(0.0), *[F.col(f"t{i}_{j}") / len(_grams(t)) for j, t in enumerate(TEMPLATES[families[i]])])
    # the likeliest window of each family and its best containment in any window; containment of a whole template settles the family
    within = F.col("at.start") + F.col("at.size") <= F.col("n_own")
    best = per.groupBy("key", "doc", "line", within.alias("within")).agg(*[F.max(p(i)).alias(f"p{i}") for i in range(len(families))], *[F.max(over(i)).alias(f"o{i}") for i in range(len(families))])
    one = lambda i: F.struct((F.col(f"o{i}") == 1).alias("whole"), ((F.col(f"p{i}") >= MIN_PROBABILITY) | (F.col(f"o{i}") == 1)).alias("sure"), F.col(f"p{i}").alias("p"), F.col(f"o{i}").alias("o"), F.lit(families[i]).alias("f"))
    out = best.select("key", "doc", "line", "within", F.array_max(F.array(*map(one, range(len(families))))).alias("b"))
    own, crossing = (F.max(F.when(F.col("within") == w, F.col("b"))) for w in (True, False))
    out = out.groupBy("key", "doc", "line").agg(own.alias("own"), crossing.alias("crossing"))
    # a window that reaches into the next lines counts only where it holds more of a template than those do by themselves
    sure = F.coalesce(F.col("own.sure"), F.lit(False))
    later = F.max(F.when(sure, F.col("own.o"))).over(Window.partitionBy("key", "doc").orderBy("line").rangeBetween(1, LATER))
    theirs = F.col("crossing").isNull() | (F.coalesce(later, F.lit(-1.0)) >= F.col("crossing.o"))
    out = out.withColumn("b", F.when(theirs, F.coalesce("own", "crossing")).otherwise(F.greatest("own", "crossing")))
    return out.select("key", "line", F.when(F.col("b.sure"), F.col("b.f")).otherwise("unknown").alias("family"), F.round("b.p", 6).alias("probability"), F.round("b.o", 6).alias("overlap"), (F.col("b.sure") & (F.col("b.o") >= MIN_OVERLAP)).alias("confirmed"))
