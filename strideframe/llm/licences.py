"""Licence notices by a trained paragraph classifier and template comparison.

A paragraph is a line of the text.  Its features are hashed single words and word pairs; a softmax regression over licence
families and ``none`` is fitted on the templates below, whole, thinned out and set among other words, and on
paragraphs of about ``NEGATIVE_DOCS`` documents (chosen by a hash of the text; about ``NEGATIVE_LINES`` lines, by a hash
of text and line number) without a template match or a word of ``_NOTICE`` as ``none``.
A fifth of the rows calibrates the probabilities by a temperature.  A paragraph that is likely no ``none`` is compared with
the templates of its likeliest family: at least ``CONFIRMED`` of one template's ``SHINGLE``-word runs
confirm it.  Otherwise, or below the probability ``SURE``, it is ``unknown``.  A paragraph without
a single run of any template is ``unknown`` too if it has ``SHINGLE`` words and the calibrated probability of a licence is at least ``UNKNOWN``, else none.

Notices of the listed families are also sought in the words of the whole text, whatever its line breaks and comment
marks: where a stretch of at most ``STRETCH`` times a template's words holds ``CONFIRMED`` of its runs, it is a notice of
that family, without regard to the classifier; of overlapping stretches the best covered one counts.  Such a notice has
the number of its first line, and replaces what was found on its lines.

All texts are scored whole, with numpy over Arrow batches, and no shuffle.  Defined cases: null and empty texts have no
paragraph and no family; a document may hold several families; repeated rows are judged alike; without
documents the classifier is fitted on the templates alone; only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.registry import query, table
from strideframe.llm.textkit import PLAIN, U64, run_hashes, slices, words_of

SIZE, SHINGLE, CONFIRMED, SURE, UNKNOWN, STRETCH, NEGATIVE_DOCS, NEGATIVE_LINES = 1 << 15, 5, 0.8, 0.6, 0.9, 1.5, 500, 4000
Batches = Iterator[pa.RecordBatch]
#: A line with one of these words may be a notice of another family: no safe example of ``none``.
_NOTICE = re.compile(r"licen[cs]|copyright|permission|redistribut|warrant", re.IGNORECASE)

# Phrases of public licence notices, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
CLASSES = [*TEMPLATES, "none"]


def paragraphs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and of each line with words: its text, its number in the text and its first word."""
    words = words_of(texts, fold=PLAIN)
    breaks = np.flatnonzero(words.data == 0x0A)
    line, owner = np.searchsorted(breaks, words.start), words.owner()
    if not len(owner):
        return words.code, *(np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])]))
    sizes = np.array([0, *np.cumsum([len((t or "").encode()) for t in texts.to_pylist()])])
    base = np.searchsorted(breaks, sizes[:-1])
    return words.code, owner[first], line[first] - base[owner[first]], first


def _features(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all paragraphs in turn, and where each paragraph's begin."""
    n = len(code)
    at = np.arange(n)
    last = np.zeros(n, bool)
    last[np.concatenate([first[1:], [n]]) - 1] = True
    pair = run_hashes(code, at, np.minimum(at + 2, n))
    both = np.empty(2 * n, np.int64)
    both[0::2], both[1::2] = (code & U64(SIZE - 1)).astype(np.int64), np.where(last, -1, (pair & U64(SIZE - 1)).astype(np.int64))
    kept = both >= 0
    begin = np.concatenate([[0], np.cumsum(kept)])[2 * first]
    return both[kept], begin


def _sums(rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, begin, axis=0)


class Model:
    """Softmax weights, the temperature and the template runs of each family."""

    def __init__(self, none: list[str]):
        rng = np.random.default_rng(5)
        filler = [w for t in none for w in t.split()] or ["filler"]
        texts, labels = [], []
        for k, family in enumerate(TEMPLATES):
            for t in TEMPLATES[family]:
                words = t.split()
                for i in range(24):
                    some = [w for w in words if i < 4 or rng.random() > 0.08]
                    around = [filler[x] for x in rng.integers(0, len(filler), (i % 4) * len(words))]
                    cut = int(rng.integers(0, len(around) + 1))
                    texts.append(" ".join(around[:cut] + some + around[cut:]))
                    labels.append(k)
        self.shingles = {f: [self._runs(t) for t in ts] for f, ts in TEMPLATES.items()}
        known = set().union(*(s for runs in self.shingles.values() for s in runs))
        self.known = np.array(sorted(known), np.uint64)
        self.holders: dict[int, list[tuple[str, int]]] = {}
        for f, all_runs in self.shingles.items():
            for i, runs in enumerate(all_runs):
                for h in runs:
                    self.holders.setdefault(h, []).append((f, i))
        rest = [t for t in none if t.split() and not _NOTICE.search(t) and not self._runs(t) & known] + ["filler"]
        texts += rest
        labels += [len(CLASSES) - 1] * len(rest)
        self._fit(texts, np.array(labels), rng)

    @staticmethod
    def _runs(text: str) -> set[int]:
        code = words_of(pa.array([text]), fold=PLAIN).code
        at = np.arange(max(1, len(code) - SHINGLE + 1))
        return set(run_hashes(code, at, np.minimum(at + SHINGLE, len(code))).tolist())

    def _fit(self, texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> None:
        code, _, _, first = paragraphs(pa.array([t.replace("\n", " ") for t in texts]))
        flat, begin = _features(code, first)
        n, count = len(begin), np.diff(np.concatenate([begin, [len(flat)]]))
        owner, value = np.repeat(np.arange(n), count), np.repeat(1 / np.sqrt(count), count)
        train = rng.random(n) > 0.2
        size = np.bincount(labels[train], minlength=len(CLASSES)).clip(min=1)
        share = np.where(train, 1 / size[labels], 0)
        share /= share.sum()
        target = np.eye(len(CLASSES))[labels]
        w, b = np.zeros((SIZE, len(CLASSES))), np.zeros(len(CLASSES))
        vw, vb = w, b
        for k in range(60):
            z = _sums(vw[flat] * value[:, None], begin) + vb
            p = np.exp(z - z.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - target) * share[:, None]
            grad = np.stack([np.bincount(flat, weights=error[owner, c] * value, minlength=SIZE) for c in range(len(CLASSES))], 1) + 1e-5 * vw
            nw, nb = vw - 30 * grad, vb - 3 * error.sum(0)
            vw, vb, w, b = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b), nw, nb
        self.weights, self.bias = w.astype(np.float32), b
        z = (_sums(w[flat] * value[:, None], begin) + b)[~train]

        def loss(t: float) -> float:
            q = z / t - (z / t).max(1, keepdims=True)
            return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(q)), labels[~train]]).mean()) if len(z) else 0.0

        self.temperature = min(2.0 ** np.arange(-3, 4, 0.25), key=loss)

    def probabilities(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        flat, begin = _features(code, first)
        count = np.diff(np.concatenate([begin, [len(flat)]]))
        z = (_sums(self.weights[flat], begin) / np.sqrt(count)[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def similarity(self, code: np.ndarray, family: str) -> float:
        """The largest share of one template's runs that the words hold."""
        best = 0.0
        for runs in self.shingles[family]:
            at = np.arange(max(0, len(code) - SHINGLE + 1))
            found = set(run_hashes(code, at, at + SHINGLE).tolist()) if len(at) else set()
            best = max(best, len(runs & found) / len(runs))
        return best


    def stretches(self, code: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, str, float]]:
        """First word, end, family and coverage of the template stretches in the words of all texts; none overlap."""
        at = np.arange(max(0, len(code) - SHINGLE + 1))
        at = at[owner[at] == owner[at + SHINGLE - 1]]
        if not len(at):
            return []
        runs = run_hashes(code, at, at + SHINGLE)
        hit = np.isin(runs, self.known)
        places: dict[tuple[int, str, int], list[tuple[int, int]]] = {}
        for i, h in zip(at[hit].tolist(), runs[hit].tolist()):
            for holder in self.holders[h]:
                places.setdefault((int(owner[i]), *holder), []).append((i, h))
        found = []
        for (_, family, which), marks in places.items():
            of = len(self.shingles[family][which])
            most, left, held = STRETCH * (of + SHINGLE - 1) + SHINGLE, 0, {}
            for i, h in marks:
                held[h] = held.get(h, 0) + 1
                while i + SHINGLE - marks[left][0] > most or held[marks[left][1]] > 1:
                    gone = marks[left][1]
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                    left += 1
                if len(held) >= CONFIRMED * of:
                    found.append((-len(held) / of, -len(held), marks[left][0], i + SHINGLE, family))
        kept: list[tuple[int, int, str, float]] = []
        for share, _, start, stop, family in sorted(found):
            k = bisect_left(kept, (start,))
            if (k == 0 or kept[k - 1][1] <= start) and (k == len(kept) or kept[k][0] >= stop):
                insort(kept, (start, stop, family, -share))
        return kept


def _judge(model):
    def run(batches: Batches) -> Batches:
        m: Model = model.value
        for batch in (part for whole in batches for part in slices(whole, "text")):
            code, owner, line, first = paragraphs(batch.column("text"))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            if len(first):
                p = m.probabilities(code, first)
                ends = np.concatenate([first[1:], [len(code)]])
                for i in np.flatnonzero(p[:, -1] < 0.5).tolist():
                    k = int(p[i, :-1].argmax())
                    words = code[first[i] : ends[i]]
                    alike = m.similarity(words, CLASSES[k])
                    if (p[i, -1] > 1 - UNKNOWN or len(words) < SHINGLE) and alike == 0 and not any(m.similarity(words, f) for f in TEMPLATES):
                        continue
                    # a family's share among the licence classes; ``none`` has been ruled out
                    sure = float(p[i, k] / (1 - p[i, -1]))
                    found[owner[i]].append({"paragraph": int(line[i]), "family": CLASSES[k] if alike >= CONFIRMED and sure >= SURE else "unknown", "likeliest": CLASSES[k], "probability": float(p[i, k]), "similarity": alike})
                of_word, line_of = (np.repeat(x, ends - first) for x in (owner, line))
                for start, stop, family, share in m.stretches(code, of_word):
                    text, a, z = int(of_word[start]), int(line_of[start]), int(line_of[stop - 1])
                    p_family = float(m.probabilities(code[start:stop], np.zeros(1, np.int64))[0, CLASSES.index(family)])
                    kept = [x for x in found[text] if x.get("stretch") or not a <= x["paragraph"] <= z]
                    found[text] = [*kept, {"paragraph": a, "family": family, "likeliest": family, "probability": p_family, "similarity": share, "stretch": True}]
                found = [sorted(({k: v for k, v in x.items() if k != "stretch"} for x in some), key=lambda x: x["paragraph"]) for some in found]
            n = np.bincount(owner, minlength=batch.num_rows).astype(np.int64)
            kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("likeliest", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(found, kind)], ["doc_id", "n_paragraphs", "notices"])

    return run


def licence_notices(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_paragraphs, families (confirmed, sorted), n_unknown and the notices."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_kind = dict(source.dtypes)["doc_id"]
    share = min(1.0, NEGATIVE_DOCS / max(1, source.count()))
    sample = source.where(F.col("text").isNotNull() & (F.shiftrightunsigned(F.xxhash64("text"), 1) <= min(int(share * 2**63), 2**63 - 1)))
    lines = sample.select(F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    part = min(1.0, NEGATIVE_LINES / max(1, lines.count()))  # about NEGATIVE_LINES lines, each as likely as any other
    lines = [r[0] for r in lines.where(F.shiftrightunsigned(F.xxhash64("h", "at"), 1) <= min(int(part * 2**63), 2**63 - 1)).select("line").collect()]
    model = spark.sparkContext.broadcast(Model(lines))
    notices = "array<struct<paragraph:long,family:string,likeliest:string,probability:double,similarity:double>>"
    out = source.mapInArrow(_judge(model), f"doc_id {id_kind}, n_paragraphs long, notices {notices}")
    names = F.transform("notices", lambda x: x["family"])
    return out.select("doc_id", "n_paragraphs", F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "unknown"))).alias("families"), F.size(F.filter(names, lambda x: x == "unknown")).cast("long").alias("n_unknown"), "notices")


@query("op5_licences")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of all documents."""
    return licence_notices(table(spark, folder, "documents"))
