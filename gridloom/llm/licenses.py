"""License scan: a trained paragraph classifier over word n-grams, in DataFrame operations only.

A paragraph ends at a blank line, so a notice wrapped over several lines is whole. It is read in windows of WINDOW
words, half of them new in each, which cover all of it; so a notice within a long paragraph has a window of its own. A
window's features are its one-, two- and three-word sequences that the model knows. A sparse multinomial logistic
regression gives a probability for each family and for unknown; it is trained on windows of the notices below, short
ones and whole ones, set into real prose, and on prose and sentences that mention licences without granting one. A
temperature and the least probability of a known family are fitted on windows kept from training. The family is
confirmed if the segment around the window holds four fifths of the word pairs of one of the family's templates.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import once
from gridloom.llm.samples import labelled_sample

# Notices of public licences, by family: short ones first, then the paragraphs of whole ones.
TEMPLATES = {
    "mit": ["released under the mit license", "licensed under the mit license", "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "apache-2.0": ["licensed under the apache license version 2 0", "spdx license identifier apache 2 0", "released under apache 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0", "distributed under the gnu gpl v3", "licensed under gplv3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-2.0": ["this work is licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0", "distributed under the gnu gpl v2", "licensed under gplv2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl": ["licensed under the gnu lesser general public license", "spdx license identifier lgpl 2 1", "distributed under the gnu lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl-3.0": ["licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3 0", "distributed under the gnu agpl v3",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"],
    "bsd": ["licensed under the bsd license", "released under the bsd license", "spdx license identifier bsd 3 clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "mpl-2.0": ["licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "cc-by": ["licensed under cc by 4 0", "released under cc by 4 0", "spdx license identifier cc by 4 0", "available under creative commons attribution 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "released under cc by sa 4 0", "spdx license identifier cc by sa 4 0", "available under creative commons attribution sharealike 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "released under cc by nc 4 0", "spdx license identifier cc by nc 4 0", "available under creative commons attribution noncommercial 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc0": ["released under cc0 1 0 universal public domain dedication", "spdx license identifier cc0 1 0", "dedicated to the public domain",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "isc": ["licensed under the isc license", "spdx license identifier isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "all-rights-reserved": ["all rights reserved", "copyright all rights reserved no part of this work may be reproduced without permission"],
}
# Sentences that hold words of notices but grant nothing.
OTHERS = [
    "you must accept the license before you can drive a car", "the driver lost a license after the accident", "a fishing license costs ten dollars each year", "see the license file for details",
    "human rights and civil rights are protected by law", "she reserved a table for two", "the public library opens at nine", "general knowledge questions for the public", "the commons voted on the bill", "a creative writing class",
    "the software has a bug in version 2", "version 3 of the report was released today", "the apache are a people of the southwest", "mit is a university in cambridge", "he has permission to leave early", "terms of use may change",
    "copyright law is taught in the second year", "the foundation gives free meals", "the album was released under a new name", "license plates are made of metal", "the gnu is a large antelope", "redistribution of wealth",
    "the city granted a building permit free of charge to any person", "copies of the report are included in the file", "the source of the river and its conditions", "the following conditions are met", "without any warranty the seller offers no refund",
]
UNKNOWN = "unknown"
CONFIRM = 0.8
WORD = "[^a-z0-9]+"
#: A blank line, or several, between two paragraphs.
BLANK = r"\n(?:[ \t\r]*+\n)++"
#: Words of a window, and of new ones in each.
WINDOW, STEP = 32, 16
#: Words of a paragraph that are looked at together; a window begins in one segment only.
SEGMENT = 512
#: Features at most, and slots of the table that finds them.
FEATURES, SLOTS = 2047, 32749
#: Documents of prose that the model is trained with, chosen by hash.
PROSE = 300
#: Share of held-out prose windows that may pass for a family.
FALSE_ALARMS = 0.0005
_FACTOR, _PRIME = 31, 2147483647
#: What two- and three-word values are moved by, so that no two kinds are alike.
_TAGS = (1 << 32, 1 << 33)


def words_of(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if w]


def values_of(words: list[str]) -> list[list[int]]:
    """A number for each one-, two- and three-word sequence, by the place of its first word."""
    one = [zlib.crc32(w.encode()) for w in words]
    two = [(a * _FACTOR + b) % _PRIME for a, b in zip(one, one[1:], strict=False)]
    three = [(a * _FACTOR + b) % _PRIME for a, b in zip(two, one[2:], strict=False)]
    return [one, [v + _TAGS[0] for v in two], [v + _TAGS[1] for v in three]]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def variants(notice: list[str], prose: list[list[str]], rng: random.Random, many: int) -> list[list[str]]:
    """Windows of a notice: as it is (cut into windows if it is long), and with words left out and prose put around it."""
    cuts = [notice[i : i + WINDOW] for i in range(0, max(1, len(notice) - STEP), STEP)]
    out = list(cuts)
    for _ in range(many):
        base = rng.choice(cuts)
        kept = [w for w in base if rng.random() > 0.06] or base
        room = max(0, WINDOW - len(kept))
        around = rng.choice(prose) if prose and rng.random() < 0.8 else []
        a = rng.randrange(min(room, len(around)) + 1)
        at = rng.randrange(max(1, len(around) - room))
        out.append((around[at : at + a] + kept + around[at + a : at + room])[:WINDOW])
    return out


@dataclass
class Model:
    """Features by slot, weights (classes x features), biases, temperature, and the least probability of a known family."""

    families: list[str]
    check: list[int]  # the value of the feature in each slot, or -1
    index: list[int]  # and its number
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def known(self, value: int) -> int | None:
        slot = value % SLOTS
        return self.index[slot] if self.check[slot] == value else None

    def logits(self, features: set[int]) -> np.ndarray:
        return (self.bias + self.weights[:, sorted(features)].sum(axis=1) / np.sqrt(len(features) + 1.0)) / self.temperature

    def segments(self, text: str) -> list[tuple[int, int, str, float, float]]:
        """(paragraph, segment, family, score, similarity) of a whole text by plain loops: what scan() does in Spark."""
        out = []
        for k, paragraph in enumerate(re.split(BLANK, text)):
            words = words_of(paragraph)
            for s in range(0, len(words), SEGMENT):
                part = words[s : s + SEGMENT + STEP]
                hits = [(i, j) for values in values_of(part) for i, v in enumerate(values) if (j := self.known(v)) is not None]
                best: dict[str, float] = {}
                for i in range(SEGMENT // STEP):
                    start = i * STEP
                    if start and (start >= SEGMENT or start + STEP >= len(part)):
                        break
                    if s and not i and STEP >= len(part):
                        break  # the window before covers it
                    features = {j for at, j in hits if start <= at < start + WINDOW}
                    p = softmax(self.logits(features))
                    top = int(p.argmax())
                    if self.families[top] != UNKNOWN and p[top] >= self.least:
                        best[self.families[top]] = max(best.get(self.families[top], 0.0), float(p[top]))
                held = {j for _, j in hits}
                out += [(k, s // SEGMENT, f, p, max((len(held & t) / len(t) for t in self.templates(f)), default=0.0)) for f, p in best.items()]
        return out

    def templates(self, family: str) -> list[set[int]]:
        """The features that are word pairs of each template of a family."""
        return [x for t in TEMPLATES[family] if (x := {j for v in values_of(words_of(t))[1] if (j := self.known(v)) is not None})]

    def gains(self) -> tuple[np.ndarray, float]:
        """What each feature can give a family over unknown at most, and what a window needs at least, times its norm, not to be unknown."""
        return np.maximum(0.0, (self.weights[:-1] - self.weights[-1]).max(axis=0)), float((self.bias[-1] - self.bias[:-1]).min()) - 1e-9


def train(prose: list[str] | None = None, steps: int = 150, l1: float = 8e-5) -> Model:
    """A model from the notices and texts of prose. Windows of prose that hold most of a template are left out."""
    rng = random.Random(3)
    families = [*TEMPLATES, UNKNOWN]
    short = [set(values_of(words_of(t))[1]) for ts in TEMPLATES.values() for t in ts]
    running = [w[i : i + WINDOW] for text in prose or [] for paragraph in re.split(BLANK, text) for w in [words_of(paragraph)] for i in range(0, max(1, len(w)), WINDOW) if w]
    clean = [w for w in running if not any(len(t & set(values_of(w)[1])) > 0.5 * len(t) for t in short)]
    rng.shuffle(clean)
    plain = clean[:2500]
    rows = [(v, k, i) for k, family in enumerate(families[:-1]) for t in TEMPLATES[family] for i, v in enumerate(variants(words_of(t), plain, rng, 30))]
    rows += [(v, len(TEMPLATES), i) for t in OTHERS for i, v in enumerate(variants(words_of(t), plain, rng, 24))]
    rows += [(w[: rng.randrange(1, WINDOW + 1)] if rng.random() < 0.3 else w, len(TEMPLATES), i) for i, w in enumerate(plain)]
    # features: the sequences of notices and others, and what is common in prose
    wanted: dict[int, int] = {}
    for t in [*(t for ts in TEMPLATES.values() for t in ts), *OTHERS]:
        for values in values_of(words_of(t)):
            for v in values:
                wanted[v] = 1 << 30
    for w in plain:
        for v in {v for values in values_of(w) for v in values}:
            wanted[v] = wanted.get(v, 0) + 1
    check, index = [-1] * SLOTS, [0] * SLOTS
    chosen: list[int] = []
    for v, n in sorted(wanted.items(), key=lambda x: (-x[1], x[0])):
        if len(chosen) < FEATURES and n > 3 and check[v % SLOTS] < 0:
            check[v % SLOTS], index[v % SLOTS] = v, len(chosen)
            chosen.append(v)
    number = {v: j for j, v in enumerate(chosen)}
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, (w, _, _) in enumerate(rows):
        at = [number[v] for v in {v for values in values_of(w) for v in values} if v in number]
        x[i, at] = 1 / np.sqrt(len(at) + 1.0)
    y = np.array([k for _, k, _ in rows])
    held = np.array([i % 6 == 5 for *_, i in rows])
    share = np.bincount(y[~held], minlength=len(families)).astype(np.float32)
    target = np.eye(len(families), dtype=np.float32)[y[~held]]
    weight = (1 / np.sqrt(share[y[~held]] + 1))[:, None]
    weight /= weight.sum()
    xf = x[~held]
    w, b = np.zeros((len(chosen), len(families)), np.float32), np.zeros(len(families), np.float32)
    last, rate = w.copy(), 60.0
    for n in range(steps):  # accelerated proximal gradient steps: small weights are zero
        ahead = w + n / (n + 3) * (w - last)
        g = (softmax(xf @ ahead + b) - target) * weight
        last = w
        moved = ahead - rate * (xf.T @ g)
        w = np.sign(moved) * np.maximum(np.abs(moved) - rate * l1, 0)
        b = b - 2.0 * g.sum(axis=0)
    rounded = lambda m: np.array([float(f"{v:.6g}") for v in m.ravel()]).reshape(m.shape)
    weights, bias = rounded(w.T), rounded(b)
    z, known = x[held].astype(np.float64) @ weights.T + bias, y[held]
    grid = [0.1 * 1.12**i for i in range(40)]
    temperature = min(grid, key=lambda t: float(-np.log(np.maximum(softmax(z / t)[np.arange(len(known)), known], 1e-12)).mean())) if len(known) else 1.0
    p = softmax(z / temperature)
    alarms = np.sort(p[known == len(TEMPLATES)][:, :-1].max(axis=1)) if (known == len(TEMPLATES)).any() else np.array([0.5])
    least = float(np.clip(alarms[int((1 - FALSE_ALARMS) * (len(alarms) - 1))], 0.5, 0.95))
    return Model(families, check, index, weights, bias, temperature, least)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prose: int = PROSE) -> Model:
    """Train with the prose of at most so many whole documents."""
    rows = labelled_sample(docs, docs.select(id_col, F.lit(0).alias("label")), prose, id_col, text_col)
    return train([text for _, text, _ in rows])


def numbers(values: list, kind: str = "double") -> Column:
    """An array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each family in a segment of a paragraph: doc_id, paragraph, segment (both from 0), family, score, similarity, confirmed, text.

    score is the family's largest calibrated probability among the segment's windows, similarity the largest share of a
    template's word pairs that the segment holds, text the segment's words. A segment is a whole paragraph, or SEGMENT
    words of a longer one. What is of the unknown class has no row, so documents that are null, empty or
    free of licences have none. Repeated rows give repeated rows. More columns are not looked at. By default the
    model is fitted with prose of docs.
    """
    model = model or fit(docs, id_col, text_col)
    check, index = numbers(model.check, "bigint"), numbers(model.index, "int")
    paragraphs = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col).cast("string"), BLANK)).alias("paragraph", "p"))
    words = once(paragraphs, "ws", F.filter(F.split(F.lower("p"), WORD), lambda x: x != "")).where(F.size("ws") > 0).drop("p")
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / F.lit(SEGMENT)).cast("int")), lambda k: F.slice("ws", k * SEGMENT + 1, SEGMENT + STEP))
    parts = words.select("doc_id", "paragraph", F.posexplode(cuts).alias("segment", "w"))
    parts = parts.where((F.col("segment") == 0) | (F.size("w") > STEP))  # words that the last window before covers have none of their own
    one = once(parts, "v1", F.transform("w", lambda x: F.crc32(x.cast("binary"))))
    mixed = lambda a, n: F.zip_with(a, F.slice("v1", n, SEGMENT + STEP), lambda x, y: (x * _FACTOR + y) % _PRIME)
    two = once(one, "v2", mixed("v1", 2))
    three = once(two, "v3", mixed("v2", 3))

    def places(values: str, tag: int) -> Column:
        """Place and number of each known sequence, as place * (FEATURES + 1) + number; null for the others."""
        slot = lambda v: ((v + tag) % SLOTS + 1).cast("int")
        return F.transform(values, lambda v, i: F.when(F.element_at(check, slot(v)) == v + tag, i * (FEATURES + 1) + F.element_at(index, slot(v))))

    hits = once(three, "hits", F.array_compact(F.concat(places("v1", 0), places("v2", _TAGS[0]), places("v3", _TAGS[1])))).where(F.size("hits") > 0)
    last = F.least(F.lit(SEGMENT // STEP - 1), F.greatest(F.lit(0), F.ceil((F.size("w") - WINDOW) / F.lit(STEP)).cast("int")))
    begin = lambda i: i * (STEP * (FEATURES + 1))
    feature = lambda h: h % (FEATURES + 1)
    window = lambda i: F.array_distinct(F.transform(F.filter("hits", lambda h: (h >= begin(i)) & (h < begin(i + WINDOW // STEP))), feature))
    gains, needed = model.gains()
    norm = lambda f: F.sqrt(F.size(f) + F.lit(1.0))
    total = lambda table, f: F.aggregate(f, F.lit(0.0), lambda acc, j: acc + F.element_at(table, j + 1))
    gain = numbers(gains.tolist())
    lift = lambda h: F.element_at(gain, feature(h) + 1)
    # a window whose features can't lift any family over unknown is not scored; most segments have no feature that lifts one
    strong, at = hits, F.sequence(F.lit(0), last)
    if needed > 0:
        strong = once(hits, "strong", F.filter("hits", lambda h: lift(h) > 0)).where(F.size("strong") > 0)
        lifted = lambda i: F.aggregate(F.filter("strong", lambda h: (h >= begin(i)) & (h < begin(i + WINDOW // STEP))), F.lit(0.0), lambda acc, h: acc + lift(h))
        at = F.filter(at, lambda i: lifted(i) + F.lit(1e-9) >= F.lit(needed * math.sqrt(2.0)))
    some = once(strong, "at", at).where(F.size("at") > 0)
    near = once(some, "windows", F.filter(F.transform("at", window), lambda f: total(gain, f) + F.lit(1e-9) >= F.lit(needed) * norm(f))).where(F.size("windows") > 0)
    tables = [(numbers(v.tolist()), float(b)) for v, b in zip(model.weights, model.bias, strict=True)]
    scores = lambda f: F.array(*[(F.lit(b) + total(t, f) / norm(f)) / F.lit(model.temperature) for t, b in tables])
    logits = once(near, "z", F.transform("windows", scores))
    top = F.transform("z", lambda z: F.struct(F.array_position(z, F.array_max(z)).cast("int").alias("k"), (F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max(z)))).alias("p")))
    good = once(logits, "found", F.filter(top, lambda t: (t["k"] <= len(TEMPLATES)) & (t["p"] >= model.least))).where(F.size("found") > 0)
    each = good.select("doc_id", "paragraph", "segment", "w", "found", F.array_distinct(F.transform("hits", feature)).alias("held"), F.explode(F.array_distinct(F.col("found.k"))).alias("k"))
    score = F.array_max(F.transform(F.filter("found", lambda t: t["k"] == F.col("k")), lambda t: t["p"]))
    similar = F.lit(0.0)
    for k, family in enumerate(TEMPLATES):
        shares = [F.size(F.array_intersect(F.array(*map(F.lit, sorted(t))), F.col("held"))) / F.lit(float(len(t))) for t in model.templates(family)]
        similar = F.when(F.col("k") == k + 1, F.greatest(F.lit(0.0), F.lit(0.0), *shares)).otherwise(similar)
    found = once(each.withColumn("score", score), "similarity", similar)
    family = F.element_at(F.array(*map(F.lit, model.families)), F.col("k"))
    return found.select("doc_id", "paragraph", "segment", family.alias("family"), "score", "similarity", (F.col("similarity") >= CONFIRM).alias("confirmed"), F.concat_ws(" ", "w").alias("text"))
