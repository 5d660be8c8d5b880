"""Licence scan: a trained paragraph classifier with a calibrated unknown class, confirmed against templates.

A sparse multinomial logistic regression over word n-grams (1 to 3) is fitted on the driver from the sentences below; it
is a few hundred weights, whatever the input. Its unknown class is calibrated on names and families that a fit has not
seen (calibrate()). Scanning is one projection of DataFrame functions over the texts: no
shuffle, no Python on the executors. Only n-grams with a cue word carry weights, so a paragraph without any is unknown by
the bias alone, and a search for cue words decides which paragraphs need scores.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Least probability of a family, and what confirms it: the share of a notice's words that the line and the words around
#: it have, the share of a name and a word that grants within REACH words of each other, or what a bare name has in
#: common with all words of the line.
LEAST_PROBABILITY, LEAST_OVERLAP, REACH = 0.5, 0.6, 5
#: Slots of the table of weights: several times as many as there are weights.
_SLOTS = 4096

# Names and notices of licence families, as their publishers word them.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "AGPL", "AGPL-3.0", "AGPLv3"],
    "Apache": ["Apache License", "Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0", "Apache Software License"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License"],
    "CC-BY": ["CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0": ["CC0", "CC0 1.0", "CC0-1.0", "CC0 1.0 Universal public domain dedication"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GPL", "GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0-or-later", "GNU GPL"],
    "ISC": ["ISC License", "ISC", "ISC licence", "ISC-Veillard"],
    "LGPL": ["GNU Lesser General Public License", "LGPL", "LGPL-2.1", "LGPLv3"],
    "MIT": ["MIT License", "MIT licence", "MIT", "MIT-0", "Expat License"],
    "MPL": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0"],
}
CARRIERS = [
    "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This work is licensed under {}.",
    "SPDX-License-Identifier: {}", "License: {}", "This program is distributed under the terms of the {}.", "This project is available under the {}.",
    "Code is {} licensed.", "Distributed under the {}. See LICENSE for more information.", "The source is covered by the {}.", "{}",
]
NOTICES = {
    "AGPL": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "Apache": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
OTHERS = [
    "A driving license is required for this job.", "The license plate was lost.", "He was licensed to practise medicine in the state.", "Students at MIT built a robot.",
    "The Apache helicopter landed.", "The Apache people lived in the plains.", "All rights reserved.", "Copyright law was discussed in the meeting.", "Copyright 2020 Example Inc.",
    "You need permission to enter.", "Permission was granted by the council.", "The warranty covers two years.", "Please license this song before use.", "A fishing licence costs ten pounds.",
    "The general public was invited.", "Creative writing is taught here.", "The commons voted on the bill.", "Mozilla released a browser.", "A gnu is a large antelope.", "He sent a cc of the mail.",
    "See the license for details.", "The licence agreement was signed by both parties.", "License fees are due in March.", "Poetic license", "The bar lost its liquor license.",
    "Version 2.0 was released under great pressure.", "The work was released under the title Attribution.", "Redistribution of wealth was debated.", "This domain is public.", "License to drive",
    "GPL is an acronym with many meanings", "Copyright of the publisher, used with permission.", "The lesser general public of the town", "isc meeting at noon", "cc by mail", "bsd is short for many things",
    "Er kam mit dem Zug.", "mit der Zeit und mit den Jahren", "sich mit einem Freund treffen", "und mit ihm", "die Frau mit dem Hund", "nicht mit mir", "mit und ohne", "Wir fahren mit",
    "MIT and BSD were named in the talk", "an apache tribe", "gpl mpl isc and other short words", "le isc et le mpl",
]
# Names of licences outside the families, as their publishers word them. They are unknown to the model.
OUTSIDE = [
    "Academic Free License version 3.0", "Artistic License 2.0", "Artistic-2.0", "Boost Software License 1.0", "BSL-1.0",
    "CC BY-NC-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-ND 4.0", "CeCILL Free Software License", "Common Development and Distribution License",
    "CDDL-1.0", "Common Public License Version 1.0", "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Eclipse Public License", "EPL-2.0",
    "European Union Public Licence", "EUPL-1.2", "GNU Free Documentation License", "GFDL-1.3", "Microsoft Public License", "MS-PL",
    "NASA Open Source Agreement", "Open Data Commons Open Database License", "Open Software License 3.0", "PostgreSQL License",
    "Python Software Foundation License", "Server Side Public License", "SIL Open Font License, Version 1.1", "OFL-1.1",
    "University of Illinois Open Source License", "W3C Software Notice and License", "Zope Public License", "zlib License", "Zlib",
]
CUES = (
    "license licensed licenses licensing licence licenced licences copyright spdx-license-identifier spdx mit expat apache apache-2.0 gpl gplv2 gplv3 gpl-2.0 gpl-3.0 gpl-2.0-or-later gpl-3.0-or-later "
    "lgpl lgplv3 lgpl-2.1 lgpl-3.0 agpl agplv3 agpl-3.0 gnu affero bsd bsd-2-clause bsd-3-clause mozilla mpl mpl-2.0 isc creative commons cc cc0 cc0-1.0 cc-by-4.0 cc-by-nc-4.0 cc-by-sa-4.0 "
    "permission redistribution redistributions"
).split()

#: SPDX identifiers (in lower case) of each family: the first group of a pattern is the family's part. Identifiers of one
#: family, whatever their version, -only, -or-later or port, are read as one word, the part with ANY at its end.
ANY = "+spdx"
IDENTIFIERS = [
    r"(agpl|lgpl|gpl)-[1-3](?:\.[0-9])?(?:\+|-only|-or-later)?(?:-with-[a-z0-9.+-]+)?", r"(apache)-[12]\.[01]", r"(mpl)-[12]\.[01](?:-no-copyleft-exception)?",
    r"(cc-by|cc-by-nc|cc-by-sa)-[1-4]\.[0-9](?:-(?:[a-z]{2}|igo))?", r"(cc0)-1\.0", r"0(bsd)",
    r"(bsd)-(?:[1-4]-clause(?:-[a-z0-9.-]+)?|4\.3reno|4\.3tahoe|advertising-acknowledgement|attribution-hpnd-disclaimer|inferno-nettverk|protection|source-code|source-beginning-file|systemics(?:-w3works)?)",
    r"(mit)-(?:0|advertising|click|cmu|enna|feh|festival|khronos-old|modern-variant|open-group|stk|testregex|wu)", r"(isc)-veillard",
]
_IDENTIFIER = rf"(?<![^ ])(?:{'|'.join(IDENTIFIERS)})(?![^ ])"
_PARTS = ("agpl", "apache", "bsd", "cc-by", "cc-by-nc", "cc-by-sa", "cc0", "gpl", "isc", "lgpl", "mit", "mpl")


def tokens(text: str) -> list[str]:
    clean = re.sub(r"\.+( |$)", r"\1", re.sub(r"[^a-z0-9.+-]+", " ", text.lower()))
    clean = re.sub(_IDENTIFIER, "".join(rf"\{k}" for k in range(1, len(IDENTIFIERS) + 1)) + ANY, clean)
    return [w for w in clean.split(" ") if w]


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


@dataclass
class Model:
    families: list[str]  # the unknown class is the last
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    held_out: dict[str, float]  # figures of calibrate()

    def probabilities(self, text: str) -> np.ndarray:
        logits = np.array(self.bias) + sum((np.array(self.weights[g]) for g in grams(tokens(text)) if g in self.weights), np.zeros(len(self.bias)))
        e = np.exp((logits - logits.max()) / self.temperature)
        return e / e.sum()


def examples() -> list[tuple[str, str, str, str]]:
    """(text, family, name, sentence around it): what to learn from."""
    out = [(c.format(n), f, n, c) for f, names in [*NAMES.items(), (UNKNOWN, OUTSIDE)] for n, c in itertools.product(names, CARRIERS)]
    out += [(n, f, n, "") for f, notices in NOTICES.items() for n in notices for _ in range(4)]
    return out + [(s, UNKNOWN, s, "") for s in OTHERS for _ in range(4)]


def _features(bags: list[set[str]], vocabulary: list[str]) -> list[np.ndarray]:
    """Of every bag the places of its n-grams in the vocabulary, and of the bias behind them."""
    index = {g: i for i, g in enumerate(vocabulary)}
    return [np.array([*sorted(index[g] for g in bag if g in index), len(vocabulary)]) for bag in bags]


def _logits(rows: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    return np.add.reduceat(w[np.concatenate(rows)], np.cumsum([0, *map(len, rows[:-1])]))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _fit(rows: list[np.ndarray], y: np.ndarray, size: int, penalty: float, steps: int) -> np.ndarray:
    """Weights, the bias last, by accelerated proximal gradient descent; all but the bias carry an L1 penalty."""
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = np.argsort(flat, kind="stable")
    present, first = np.unique(flat[order], return_index=True)
    w = ahead = direction = np.zeros((size + 1, y.shape[1]))

    def back(error: np.ndarray) -> np.ndarray:
        out = np.zeros_like(w)
        out[present] = np.add.reduceat(error[owner[order]], first)
        return out

    direction = direction + np.linspace(1, 2, y.shape[1])
    for _ in range(20):  # power iteration for the step that is always safe
        direction = back(_logits(rows, direction))
        norm = np.linalg.norm(direction)
        direction = direction / norm
    rate = 2 * len(rows) / norm
    for k in range(steps):
        new = ahead - rate / len(rows) * back(_softmax(_logits(rows, ahead)) - y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


def calibrate(rows: list[np.ndarray], data: list[tuple[str, str, str, str]], size: int, penalty: float, steps: int, folds: int = 4) -> tuple[float, float, dict[str, float]]:
    """Temperature and offset of the unknown class with the least log loss on what a fit has not seen.

    Each fold fits without a quarter of the families, and without a quarter of the names and of the sentences around
    names. The families left out are unknown to it; so are the names left out of those outside all families. A family's
    texts are held out with their sentence or with their name. Known and unknown texts weigh alike. The third value
    gives the shares of held-out texts that are judged right: known texts by what was left out, and unknown ones.
    """
    families = [*NAMES, UNKNOWN]
    turn: dict[str, int] = {}
    for family in families:
        turn |= {n: (i + families.index(family)) % folds for i, n in enumerate(dict.fromkeys(n for _, f, n, _ in data if f == family))}
    place = {c: i % folds for i, c in enumerate(CARRIERS)}
    held, logits = [], []
    for fold in range(folds):
        absent = set(families[:-1][fold::folds])
        kind = ["unknown" if f in absent or f == UNKNOWN and turn[n] == fold else "" if f == UNKNOWN else "name" if turn[n] == fold else "sentence" if place.get(c) == fold else "" for _, f, n, c in data]
        seen, out = [i for i, k in enumerate(kind) if not k], [i for i, k in enumerate(kind) if k]
        w = _fit([rows[i] for i in seen], np.eye(len(families))[[families.index(data[i][1]) for i in seen]], size, penalty, steps)
        z = _logits([rows[i] for i in out], w)
        z[:, [families.index(f) for f in absent]] = -1e9
        logits.append(z)
        held += [(kind[i], families.index(UNKNOWN if kind[i] == "unknown" else data[i][1])) for i in out]
    z, kinds, t = np.vstack(logits), np.array([k for k, _ in held]), np.array([f for _, f in held])
    unknown = kinds == "unknown"
    weight = np.where(unknown, 0.5 / unknown.sum(), 0.5 / (~unknown).sum())

    def chance(temperature: float, offset: float) -> np.ndarray:
        moved = z.copy()
        moved[:, -1] += offset
        return _softmax(moved / temperature)

    def loss(pair: tuple[float, float]) -> float:
        return float(-(weight * np.log(np.maximum(chance(*pair)[np.arange(len(z)), t], 1e-300))).sum())

    temperature, offset = min(itertools.product((0.25 * k for k in range(1, 17)), (0.25 * k for k in range(-8, 25))), key=loss)
    p = chance(temperature, offset)
    named = np.where(p.max(axis=1) >= LEAST_PROBABILITY, p.argmax(axis=1), len(families) - 1)
    return temperature, offset, {k: float((named == t)[kinds == k].mean()) for k in ("name", "sentence", "unknown")}


@lru_cache(maxsize=2)
def train(penalty: float = 2e-4, steps: int = 200) -> Model:
    """Fitted on all examples, with the temperature and the offset of the unknown class from calibrate(). Once a process."""
    cues, data, families = set(CUES) | {p + ANY for p in _PARTS}, examples(), [*NAMES, UNKNOWN]
    bags = [grams(tokens(t)) for t, _, _, _ in data]
    vocabulary = sorted(g for g in set().union(*bags) if cues & set(g.split(" ")))
    rows = _features(bags, vocabulary)
    w = _fit(rows, np.eye(len(families))[[families.index(f) for _, f, _, _ in data]], len(vocabulary), penalty, steps)
    temperature, offset, figures = calibrate(rows, data, len(vocabulary), penalty, steps)
    w[-1, -1] += offset
    kept = {g: [round(float(v), 6) for v in w[i]] for i, g in enumerate(vocabulary) if np.abs(w[i]).max() > 1e-3}
    return Model(families, kept, [round(float(v), 6) for v in w[-1]], temperature, figures)


def named_grants() -> dict[str, list[list[str]]]:
    """Distinct words of each family's names. A name alone is no notice: it is joined with a word that grants, as short
    names are words of other languages too."""
    grants = ("license", "licence", "licensed", "under", "spdx-license-identifier")
    out: dict[str, list[list[str]]] = {}
    for family, names in NAMES.items():
        words = [set(tokens(n)) for n in names]
        whole = [w for w in words if w & {"license", "licence", "dedication"}]
        out[family] = [sorted(w) for w in whole] + [sorted(w | {g}) for w in words if w not in whole for g in grants]
    return out


def keys() -> dict[str, list[str]]:
    """Words that only names of licences have: names are looked for around them."""
    common = {c for c in CUES if c.startswith("licen")}
    return {f: sorted({w for n in names for w in tokens(n)} & ({*CUES, *(p + ANY for p in _PARTS)} - common)) for f, names in NAMES.items()}


def notices() -> dict[str, list[list[str]]]:
    return {f: [sorted(set(tokens(n))) for n in NOTICES.get(f, [])] for f in NAMES}


def bare_names() -> dict[str, list[list[str]]]:
    return {f: [sorted(set(tokens(n))) for n in names] for f, names in NAMES.items()}


def cue_pattern() -> str:
    """Finds a cue as a whole token, as tokens() cuts them; a full stop may end it."""
    words = "|".join([*(re.escape(c).replace("\\-", "-") for c in sorted(CUES, key=len, reverse=True)), *(p.replace("(?:", "(").replace("(", "(?:") for p in IDENTIFIERS)])
    return rf"(?i)(?<![a-z0-9.+-])(?:{words})(?=\.*(?:[^a-z0-9.+-]|$))"


def _words(paragraph: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.lower(paragraph), "[^a-z0-9.+-]+", " "), r"\.+( |$)", "$1")
    clean = F.regexp_replace(clean, _IDENTIFIER, "".join(f"${k}" for k in range(1, len(IDENTIFIERS) + 1)) + ANY)
    return F.filter(F.split(clean, " "), lambda w: w != "")


def _last(words: Column, k: int) -> Column:
    return F.slice(words, F.greatest(F.size(words) - (k - 1), F.lit(1)), k)


def _grams(words: Column, by_one: Column, by_two: Column) -> Column:
    """All n-grams that hold a word of the line: by_one and by_two are its words with so many neighbours on each side."""
    rest = lambda x, k: F.slice(x, k, F.greatest(F.size(x) - (k - 1), F.lit(0)))
    joined = lambda x, y: F.zip_with(x, y, lambda a, b: F.concat(a, F.lit(" "), b))
    two = joined(by_one, rest(by_one, 2))
    three = joined(joined(by_two, rest(by_two, 2)), rest(by_two, 3))
    return F.array_distinct(F.filter(F.concat(words, two, three), lambda g: g.isNotNull()))


def _cue_lines(text: Column) -> Column:
    """Lines with a cue: array of (paragraph, line, words, before, after).

    before and after are the words of the same paragraph around the line, as many as the longest notice can still have
    there: a notice that holds a word of the line is within the three, wherever its lines were wrapped.
    """
    reach = max(len(tokens(n)) for notices in (*NAMES.values(), *NOTICES.values()) for n in notices) - 1
    has_cue = lambda t: t.rlike(cue_pattern())
    blocks = F.transform(F.split(text, r"\n\s*\n"), lambda p, i: F.struct(i.alias("paragraph"), p.alias("t")))
    lines = lambda t: F.filter(F.transform(F.split(t, r"\n"), lambda x, i: F.struct(i.alias("line"), has_cue(x).alias("cue"), _words(x).alias("words"))), lambda x: F.size(x["words"]) > 0)
    blocks = F.transform(F.filter(blocks, lambda b: has_cue(b["t"])), lambda b: F.struct(b["paragraph"].alias("paragraph"), lines(b["t"]).alias("lines")))
    blocks = F.transform(
        blocks,
        lambda b: F.struct(
            b["paragraph"].alias("paragraph"),
            F.filter(F.transform(b["lines"], lambda x, k: F.struct(k.alias("k"), x["line"].alias("line"), x["cue"].alias("cue"), x["words"].alias("words"))), lambda x: x["cue"]).alias("lines"),
            F.transform(b["lines"], lambda x: F.slice(x["words"], 1, reach)).alias("heads"),
            F.transform(b["lines"], lambda x: _last(x["words"], reach)).alias("tails"),
        ),
    )
    around = lambda b: F.transform(
        b["lines"],
        lambda x: F.struct(
            b["paragraph"].alias("paragraph"),
            x["line"].alias("line"),
            x["words"].alias("words"),
            F.flatten(F.slice(b["tails"], F.greatest(x["k"] - (reach - 1), F.lit(1)), F.least(x["k"], F.lit(reach)))).alias("before"),
            F.flatten(F.slice(b["heads"], x["k"] + 2, F.lit(reach))).alias("after"),
        ),
    )
    found = F.flatten(F.transform(blocks, around))
    return F.transform(found, lambda x: x.withField("before", _last(x["before"], reach)).withField("after", F.slice(x["after"], 1, reach)))


def _weights(model: Model) -> Callable[[Column], Column]:
    """An n-gram's weights, null if it has none: by the slot of its checksum, as a map's keys are searched one by one."""
    slots: list[list[dict]] = [[] for _ in range(_SLOTS)]
    for gram, own in model.weights.items():
        slots[zlib.crc32(gram.encode()) % _SLOTS].append({"g": gram, "w": own})
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<g:string,w:array<double>>>>")

    def weights_of(gram: Column) -> Column:
        found = F.filter(F.get(table, (F.crc32(gram.cast("binary")) % _SLOTS).cast("int")), lambda s: s["g"] == gram)
        return F.get(found, F.lit(0))["w"]

    return weights_of


def found_licences(text: Column, model: Model) -> Column:
    """Lines with a cue, in their paragraphs: array of (paragraph, line, family, probability, overlap, confirmed)."""
    weights_of = _weights(model)
    known = lambda x: F.from_json(F.lit(json.dumps(x | {UNKNOWN: []})), "map<string,array<array<string>>>")
    forms, named, bare = known(notices()), known(named_grants()), known(bare_names())
    key = F.from_json(F.lit(json.dumps(keys() | {UNKNOWN: []})), "map<string,array<string>>")
    families, bias = F.array(*[F.lit(f) for f in model.families]), F.array(*[F.lit(float(b)) for b in model.bias])
    near = lambda x, k: F.concat(_last(x["before"], k), x["words"], F.slice(x["after"], 1, k))
    cut = F.transform(
        _cue_lines(text),
        lambda x: F.struct(
            x["paragraph"].alias("paragraph"),
            x["line"].alias("line"),
            x["words"].alias("words"),
            near(x, 1).alias("by_one"),
            near(x, 2).alias("by_two"),
            F.concat(x["before"], x["words"], x["after"]).alias("near"),
        ),
    )
    scored = F.transform(
        cut,
        lambda x: F.struct(
            x["paragraph"].alias("paragraph"),
            x["line"].alias("line"),
            F.array_distinct(x["words"]).alias("words"),
            x["near"].alias("near"),
            F.transform(
                F.aggregate(
                    F.filter(F.transform(_grams(x["words"], x["by_one"], x["by_two"]), weights_of), lambda w: w.isNotNull()),
                    bias,
                    lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b),
                ),
                lambda z: F.exp(z / F.lit(model.temperature)),
            ).alias("e"),
        ),
    )
    judged = F.transform(
        scored,
        lambda x: F.struct(
            x["paragraph"].alias("paragraph"),
            x["line"].alias("line"),
            x["words"].alias("words"),
            x["near"].alias("near"),
            F.element_at(families, F.array_position(x["e"], F.array_max(x["e"])).cast("int")).alias("family"),
            (F.array_max(x["e"]) / F.aggregate(x["e"], F.lit(0.0), lambda a, b: a + b)).alias("probability"),
        ),
    )

    def granted(x: Column) -> Column:
        """The largest share of a name and its grant that stands within REACH words of a key of the family."""
        around = lambda i: F.slice(x["near"], F.greatest(i + (1 - REACH), F.lit(1)), 2 * REACH + 1)
        share = lambda i: F.array_max(F.transform(F.element_at(named, x["family"]), lambda t: F.size(F.array_intersect(t, around(i))) / F.size(t)))
        return F.array_max(F.transform(x["near"], lambda w, i: F.when(F.array_contains(F.element_at(key, x["family"]), w), share(i))))

    def noticed(x: Column) -> Column:
        return F.array_max(F.transform(F.element_at(forms, x["family"]), lambda t: F.size(F.array_intersect(t, x["near"])) / F.size(t)))

    compared = F.transform(
        judged,
        lambda x: F.struct(
            x["paragraph"].alias("paragraph"),
            x["line"].alias("line"),
            F.when(x["probability"] >= LEAST_PROBABILITY, x["family"]).otherwise(UNKNOWN).alias("family"),
            x["probability"].alias("probability"),
            F.greatest(
                noticed(x),
                granted(x),
                F.array_max(F.transform(F.element_at(bare, x["family"]), lambda t: F.size(F.array_intersect(t, x["words"])) / F.size(F.array_union(t, x["words"])))),
                F.lit(0.0),
            ).alias("overlap"),
        ),
    )
    return F.transform(compared, lambda x: x.withField("confirmed", (x["family"] != UNKNOWN) & (x["overlap"] >= LEAST_OVERLAP)))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with `licences`: for every line that has a cue word its family, probability, overlap and confirmed.

    A line is judged within its paragraph, which blank lines end: n-grams run over its ends, and templates are compared
    with the words around it too. paragraph counts the text's paragraphs from 0, line the paragraph's lines. Null and
    empty texts have none. A column of that name is replaced; other columns, nulls and repeated rows are left alone; no
    rows give no rows.
    """
    model = model or train()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.filter(found_licences(F.lit(""), model), lambda x: F.lit(False))
    return docs.withColumn("licences", F.when(text.rlike(cue_pattern()), found_licences(text, model)).otherwise(none))


def per_document(scanned: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_confirmed, families (sorted, joined by commas), best_family, best_probability."""
    good = F.filter("licences", lambda x: x["confirmed"])
    best = F.array_max(F.transform(good, lambda x: F.struct(x["probability"].alias("p"), x["family"].alias("f"))))
    return scanned.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("licences").cast("long").alias("n_candidates"),
        F.size(good).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(good, lambda x: x["family"]))), ",").alias("families"),
        F.coalesce(best["f"], F.lit(UNKNOWN)).alias("best_family"),
        F.round(F.coalesce(best["p"], F.lit(0.0)), 6).alias("best_probability"),
    )
