"""License scan: a trained paragraph classifier whose findings a template comparison confirms.

Passages (paragraphs between blank lines, long ones in overlapping windows, and the lines of paragraphs of several) are bags of hashed word 1-grams and 2-grams. A multinomial logistic
regression, trained here on variations of short public notices and on notices of neighbouring licenses and a bounded sample of
the documents' own paragraphs as the unknown class, names a license family. Its temperature is calibrated on notices held out whole; a family counts only above
``CERTAIN`` and when the passage shares enough word 2-grams with a template of the family and has a name of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm.registry import per_process, query, whole_text
from duoscope.session import scratch_path, table

# Families and the notices that stand for them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0")
#: What names a family: a passage has all 2-grams of one of these, so a neighbour's notice of nearly the same words has none.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("apache license version 2.0", "apache license version 2", "apache license 2.0", "apache license v2.0",
                   "apache license v 2.0", "apache license v2", "spdx-license-identifier apache-2.0"),
    "BSD": ("the bsd", "bsd license", "bsd 3-clause", "bsd 2-clause", "use in source", "spdx-license-identifier bsd-3-clause"),
    "CC-BY": tuple(f"{x} {v}" for x in ("cc by", "cc-by", "attribution") for v in (*VERSIONS, "license", "international")),
    "CC-BY-NC": tuple(f"{x} {v}" for v in (*VERSIONS, "license", "international") for x in (
        "by-nc", "by nc", "cc-by-nc", "attribution-noncommercial", "attribution-non-commercial", "attribution noncommercial")),
    "GPL": ("gnu general", "spdx-license-identifier gpl-3.0-or-later"),
    "MIT": ("the mit", "mit license", "hereby granted", "deal in", "spdx-license-identifier mit"),
    "MPL-2.0": ("mozilla public license v 2.0", "mozilla public license v2.0", "mozilla public license version 2.0",
                "mozilla public license 2.0", "spdx-license-identifier mpl-2.0"),
}
#: Notices of licenses near the families, unknown to this scan.
NEIGHBOURS = (
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    "This work is licensed under the GNU Lesser General Public License, version 3.",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation.",
    "SPDX-License-Identifier: LGPL-3.0-or-later",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "SPDX-License-Identifier: AGPL-3.0-or-later",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3.",
    "Licensed under CC BY-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Licensed under CC BY-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Licensed under CC BY-NC-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "Licensed under the Apache License, Version 1.1.",
    "The contents of this file are subject to the Mozilla Public License Version 1.1; you may not use this file except in compliance with the License.",
    "This Source Code Form is subject to the terms of the Eclipse Public License, v. 2.0.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce and distribute the Software.",
    "Released under the ISC License.",
    "SPDX-License-Identifier: ISC",
)
UNKNOWN = "unknown"
DIMS = 1 << 16
WINDOW, STRIDE = 40, 20
#: Paragraphs of the documents that stand for the unknown class, at most about so many; documented bound of the fit.
BACKGROUND = 3_000
VARIATIONS = 60
CERTAIN = 0.5
SHARED = 0.6
#: Distinct words a worker process remembers before it starts anew.
CACHE_WORDS = 300_000
KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz.-" + bytes(range(128, 256))
WORD_BYTES = bytes(10 if c in (10, 11, 12, 13) else c if c in KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
EDGE = b".-"
#: Comment marks that are letters or kept characters; all others are white space.
MARK = re.compile(rb"^ *(?:(?:rem|dnl|--+|\.\.|\.\\\") )? *", re.MULTILINE)
BLANK = re.compile(rb"\n(?: *\n)+")
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Hashes of words, without full stops and hyphens at their ends."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word.strip(EDGE))
        return value


def windows(words: list[bytes]) -> list[list[bytes]]:
    """The words, or windows that overlap by half, so a short notice lies whole in one of them."""
    if len(words) <= WINDOW:
        return [words] if words else []
    return [words[at:at + WINDOW] for at in range(0, len(words) - STRIDE, STRIDE)]


def passages(text: str) -> list[list[bytes]]:
    """Word lists of all passages of a text.

    Paragraphs end at blank lines; single breaks and comment marks in them are white space, so a wrapped notice is one. The
    lines of a paragraph are passages, too: a short notice among other lines is judged alone.
    """
    out = []
    plain = MARK.sub(b"", text.encode().replace(b"\r\n", b"\n").translate(WORD_BYTES))
    for paragraph in BLANK.split(plain):
        lines = [[w for w in line.split() if w.strip(EDGE)] for line in paragraph.split(b"\n")]
        lines = [line for line in lines if line]
        whole: list[bytes] = []
        for first, *rest in lines:
            if whole and whole[-1].endswith(b"-"):  # broken at a hyphen
                first = whole.pop() + first
            whole += [first, *rest]
        out += windows(whole)
        if len(lines) > 1:
            for line in lines:
                out += windows(line)
    return out


def features(found: list[list[bytes]], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all passages after another, the start of each passage and its length."""
    sizes = np.array([len(p) for p in found])
    ends = np.cumsum(sizes)
    h = np.fromiter((words[w] for p in found for w in p), np.uint64, int(ends[-1]))
    # the first word of a passage makes its 2-gram with the passage's start
    before = np.concatenate([[np.uint64(1)], h[:-1]])
    before[ends - sizes] = np.uint64(1)
    two = (before * MIX ^ h) * np.uint64(0xBF58476D1CE4E5B9)
    shift = np.uint64(48)
    return np.stack([h >> shift, two >> shift], axis=1).astype(np.int64).ravel(), 2 * (ends - sizes), sizes


def scores(weights: np.ndarray, bias: np.ndarray, feats: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[feats], starts, axis=0) / np.sqrt(sizes)[:, None] + bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def variations(rng: np.random.Generator, filler: list[bytes]) -> list[tuple[int, int, list[bytes]]]:
    """Family, number of the notice and words: notices with words lost, swapped for others or added around them."""
    out = []
    families = [*TEMPLATES.values(), NEIGHBOURS]
    known = [(k, notice) for k, notices in enumerate(families) for notice in notices]
    for number, (k, notice) in enumerate(known):
        (whole, *_) = passages(notice)
        for v in range(VARIATIONS):
            words = [w for w in whole if v < 5 or rng.random() > 0.08] or whole
            if v >= 20 and filler:
                # in the later ones as much as a window of a paragraph holds
                most = 15 if v < 40 else max(15, WINDOW - len(words) + 1)
                extra = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, most))]
                at = rng.integers(0, len(extra) + 1)
                words = [*extra[:at], *words, *extra[at:]]
            out.append((k, number, words))
    return out


def trained(rows: list[tuple[int, list[bytes]]], use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from the rows that ``use`` names."""
    chosen = [rows[i] for i in np.flatnonzero(use)]
    label = np.array([k for k, _ in chosen])
    feats, starts, sizes = features([p for _, p in chosen], Words())
    classes = len(TEMPLATES) + 1
    weights, bias = np.zeros((DIMS, classes), np.float32), np.zeros(classes, np.float32)
    row = np.repeat(np.arange(len(chosen)), 2 * sizes)
    worth = (1 / np.bincount(label, minlength=classes)[label]).astype(np.float32) / classes
    truth = np.eye(classes, dtype=np.float32)[label]
    squares = np.full((DIMS, classes), 1e-6, np.float32)
    for _ in range(40):  # full-batch steps scaled per weight
        error = (softmax(scores(weights, bias, feats, starts, sizes)) - truth) * worth[:, None]
        per = error / np.sqrt(sizes)[:, None]
        slope = 1e-5 * weights
        np.add.at(slope, feats, per[row].astype(np.float32))
        squares += slope**2
        weights -= 0.3 * slope / np.sqrt(squares)
        bias -= 0.5 * error.sum(axis=0)
    return weights, bias


def fit(docs: DataFrame, background: int = BACKGROUND, seed: int = 11) -> dict:
    """Weights, bias, temperature and templates. The unknown class is a bounded sample of paragraphs without licence words."""
    spark = docs.sparkSession
    total = docs.count()
    share = min(1.0, background / 4 / max(total, 1))
    draw = F.pmod(F.xxhash64(whole_text(docs), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    texts = [r[0] for r in docs.where(draw < share).select(whole_text(docs).alias("t")).limit(background).toLocalIterator()]
    hint = re.compile(rb"licen|copyright|spdx|permission|redistribut")
    rng = np.random.default_rng(seed)
    plain = sorted({tuple(p) for t in texts for p in passages(t) if not hint.search(b" ".join(p))})
    plain = [list(plain[i]) for i in rng.permutation(len(plain))[:background]]
    filler = [w for p in plain[:500] for w in p]
    notices = variations(rng, filler)
    number = np.array([n for _, n, _ in notices])
    rows = [(k, words) for k, _, words in notices] + [(len(TEMPLATES), p) for p in plain]
    # words of licences out of their place are unknown, too
    legal = [w for k, p in rows if k < len(TEMPLATES) for w in p]
    rows += [(len(TEMPLATES), [legal[i] for i in rng.integers(0, len(legal), rng.integers(1, 12))]) for _ in range(background // 6)]
    label = np.array([k for k, _ in rows])
    held = rng.random(len(rows)) < 0.2

    def judged(use: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        weights, bias = trained(rows, use)
        if not asked.any():
            return weights, bias, np.zeros((0, len(TEMPLATES) + 1)), label[asked]
        return weights, bias, scores(weights, bias, *features([rows[i][1] for i in np.flatnonzero(asked)], Words())), label[asked]

    # the temperature is that of a model which is asked about notices it has seen no variation of, too: one of every family and
    # every third neighbour are left out whole
    at, last = 0, []
    for family in TEMPLATES.values():
        at += len(family)
        last.append(at - 1)
    out = held | np.concatenate([np.isin(number, [*last, *range(at, at + len(NEIGHBOURS), 3)]), np.zeros(len(rows) - len(notices), bool)])
    _, _, z, want = judged(~out, out)
    loss = [-np.log(softmax(z / t)[np.arange(len(z)), want] + 1e-12).mean() for t in TEMPERATURES] if len(z) else [0.0]
    unseen = float((z.argmax(axis=1) == want).mean()) if len(z) else 0.0
    weights, bias, z, want = judged(~held, held)
    grams = [[{tuple(p[i:i + 2]) for p in [[w.strip(EDGE) for w in passages(n)[0]]] for i in range(len(p) - 1)} for n in notices]
             for notices in TEMPLATES.values()]
    named = [[set(zip(p, p[1:])) for p in (x.encode().split() for x in NAMES[family])] for family in TEMPLATES]
    # a passage without the first 2-gram of a name has no family; features that two 2-grams share only let a passage through
    flags = np.zeros(DIMS, bool)
    for family in TEMPLATES:
        for x in NAMES[family]:
            flags[features([x.encode().split()[:2]], Words())[0][3]] = True
    return {"weights": weights, "flags": flags, "bias": bias, "temperature": TEMPERATURES[int(np.argmin(loss))], "grams": grams, "names": named,
            "held_out_accuracy": float((z.argmax(axis=1) == want).mean()) if len(z) else 0.0, "unseen_accuracy": unseen}


TEMPERATURES = (0.25, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0)


def confirmed(words: list[bytes], templates: list[set], names: list[set]) -> list[bytes] | None:
    """Where the passage holds enough of a template and names the family: the words, as many as the template's, that hold most of it."""
    words = [w.strip(EDGE) for w in words]
    two = list(zip(words, words[1:]))
    own = set(two)
    if not any(n <= own for n in names):
        return None
    share, template = max(((len(own & t) / len(t), t) for t in templates), key=lambda x: x[0])
    if share < SHARED:
        return None
    at = [i for i, x in enumerate(two) if x in template]
    first = max(at, key=lambda i: sum(i <= x < i + len(template) for x in at))
    return words[first:max(x for x in at if x < first + len(template)) + 2]


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of ``docs``: doc_id, n_passages, n_licensed (confirmed passages), families (sorted), certainty (the highest
    probability of a confirmed passage, 0 without). Null and blank texts have no passages. The model is of fixed size."""
    shipped = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    names = list(TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = cloudpickle.loads(shipped.value), per_process("licenses", "words", Words)
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = passages(text.as_py())
                families, certainty, n = set(), 0.0, 0
                if found:
                    feats, starts, sizes = features(found, words)
                    named = np.flatnonzero(np.logical_or.reduceat(m["flags"][feats], starts))
                    p = softmax(scores(m["weights"], m["bias"], feats, starts, sizes) / m["temperature"]) if len(named) else None
                    for i in named:
                        licensed = False
                        for k, name in enumerate(names):
                            core = confirmed(found[i], m["grams"][k], m["names"][k])
                            if core is None:
                                continue
                            # the words around a notice make a passage less certain, so the notice is judged alone, too
                            alone = softmax(scores(m["weights"], m["bias"], *features([core], words)) / m["temperature"])[0]
                            sure = max((float(q[k]) for q in (p[i], alone) if q.argmax() == k), default=0.0)
                            if sure >= CERTAIN:
                                licensed = True
                                families.add(name)
                                certainty = max(certainty, sure)
                        n += licensed
                out.append((len(found), n, sorted(families), certainty))
            n_passages, n_licensed, families, certainty = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array(n_passages, pa.int64()), pa.array(n_licensed, pa.int64()),
                pa.array(families, pa.list_(pa.string())), pa.array(certainty, pa.float64())],
                ["doc_id", "n_passages", "n_licensed", "families", "certainty"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_passages long, n_licensed long, families array<string>, certainty double")


@query("op10_licenses")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    return found.withColumn("families", F.array_join("families", ","))
