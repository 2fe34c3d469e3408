"""License scans: a trained paragraph classifier with an unknown class, confirmed against templates.

A paragraph is a run of lines without a blank one between them. It is read in pieces: its lines, cut after every PIECE words, and
windows of up to WINDOW such pieces, so a sentence that is wrapped over lines or stands in a very long line is seen whole.
Multinomial logistic regression over hashed 1- to 3-grams of words (present or not) gives the probabilities of every licence family
and of "unknown". It is trained here, in one task, on variations of the templates below, bare and between words of the
corpus, and on a bounded sample of the corpus's own lines as unknown ones (those that match a template are left out).
A temperature fitted on held-out examples calibrates the probabilities.

Every piece is classified. A prediction is a family other than unknown with a probability of at least CUTOFF; it is confirmed if at
least CONTAINED of the 3-grams of one of the family's templates stand in the piece. Windows of several pieces are only looked at where
template 3-grams stand in them, as no other could be confirmed, and only reported where no confirmed one lies inside.

Every whole text is scanned where it lies, without a shuffle. Defined cases: null, empty and blank texts have no paragraphs; very long
texts are scanned whole; null ids and repeated rows are rows as any other; an empty table trains on the templates alone and gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

BITS = 16
CUTOFF = 0.5
CONTAINED = 0.6
PIECE, WINDOW = 32, 3
SAMPLE_TEXTS, SAMPLE_LINES = 400, 4000
VARIATIONS = 16
EPOCHS = 8

#: Names by which SPDX tags call the families, and sentences by which licences announce themselves.
TAGS: dict[str, list[str]] = {
    "AGPL": ["AGPL-3.0"], "Apache-2.0": ["Apache-2.0"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "CC-BY": ["CC-BY-4.0", "CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"],
    "CC0": ["CC0-1.0"], "EPL": ["EPL-2.0"], "GPL": ["GPL-2.0", "GPL-3.0"], "ISC": ["ISC"], "LGPL": ["LGPL-2.1", "LGPL-3.0"], "MIT": ["MIT"], "MPL-2.0": ["MPL-2.0"], "Unlicense": ["Unlicense"],
}
SENTENCES: dict[str, list[str]] = {
    "AGPL": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU AGPL version 3 or later."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License", "This project is released under the Apache 2.0 license.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Use of this source code is governed by a BSD-style license", "Released under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work", "This work is released into the public domain under CC0 1.0."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GNU GPL version 2 or later."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "LGPL": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the GNU LGPL version 2.1 or later.", "This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Licensed under the MIT license.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "Proprietary": ["All rights reserved.", "No part of this publication may be reproduced without prior written permission", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"],
}
TEMPLATES = {name: [*sentences, *(f"SPDX-License-Identifier: {tag}" for tag in TAGS.get(name, []))] for name, sentences in SENTENCES.items()}
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
_LINE = np.array([b not in (10, 13) for b in range(256)])


def grams_of(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of 1-, 2- and 3-grams, each with the index of its paragraph, for paragraphs given by offsets."""
    data = hashing.LOWER[data]
    s, e = hashing.spans(hashing.ALNUM[data], offsets)
    h, owner = hashing.span_hashes(hashing.prefix_sums(data), s, e), hashing.text_of(s, offsets)
    out = []
    for n in (1, 2, 3):
        g = hashing.ngrams(h, n)
        same = owner[: len(g)] == owner[n - 1 :] if len(g) else np.zeros(0, bool)
        out.append((g[same], owner[: len(g)][same]))
    return out, owner


def _buffer(paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return common.text_buffer(pa.array(paragraphs, pa.string()))


def _terms(grams: list[tuple[np.ndarray, np.ndarray]], count: int) -> list[np.ndarray]:
    """Distinct term ids of each paragraph."""
    ids = np.concatenate([(hashing.mix(g + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64) for n, (g, _) in enumerate(grams)])
    owner = np.concatenate([o for _, o in grams])
    key = np.unique((owner << BITS) | ids)
    return np.split(key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(1, count)))


class Templates:
    """The 3-grams of every template, to find and to confirm licences."""

    def __init__(self) -> None:
        sets, self.family = [], []
        for k, name in enumerate(FAMILIES):
            for sentence in TEMPLATES[name]:
                (_, _, (three, _)), _ = grams_of(*_buffer([sentence]))
                sets.append(np.unique(three))
                self.family.append(k)
        self.sizes = np.array([len(s) for s in sets])
        self.grams = np.concatenate(sets)
        self.template = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(self.grams, kind="stable")
        self.grams, self.template = self.grams[order], self.template[order]
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.grams >> np.uint64(48)).astype(np.int64)] = True

    def shares(self, three: np.ndarray, owner: np.ndarray, count: int) -> dict[int, np.ndarray]:
        """paragraph -> share of each family's best template, for paragraphs with any template 3-gram."""
        maybe = np.flatnonzero(self.known[(three >> np.uint64(48)).astype(np.int64)])
        low = np.searchsorted(self.grams, three[maybe], "left")
        n = np.searchsorted(self.grams, three[maybe], "right") - low
        row = np.repeat(np.arange(len(maybe)), n)
        template = self.template[low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] if len(row) else row
        seen = np.unique(np.stack([owner[maybe[row]], template, three[maybe[row]].view(np.int64)]), axis=1) if len(row) else np.zeros((3, 0), np.int64)
        found: dict[int, np.ndarray] = {}
        for p in np.unique(seen[0]):
            hits = np.bincount(seen[1][seen[0] == p], minlength=len(self.sizes)) / self.sizes
            best = np.zeros(len(FAMILIES))
            np.maximum.at(best, self.family, hits)
            found[int(p)] = best
        return found


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng, templates = np.random.default_rng(5), Templates()
    lines: list[str] = []
    for batch in batches:
        lines += [p for p in batch.column("text").to_pylist() if p and p.strip()]
    if lines:
        (_, _, (three, owner)), _ = grams_of(*_buffer(lines))
        matched = {p for p, share in templates.shares(three, owner, len(lines)).items() if share.max() >= CONTAINED}
        lines = [p for k, p in enumerate(lines) if k not in matched]
    around = ["This", "software", "is", "our", "file", "code", "and", "see", "below", "Copyright", "2024", "the", "authors"]
    texts, labels = list(lines), [UNKNOWN] * len(lines)
    for k, name in enumerate(FAMILIES):
        for sentence in TEMPLATES[name]:
            words = sentence.split()
            for v in range(VARIATIONS):
                kept = words if v % 4 == 0 else [w for w in words if rng.random() > 0.08]
                if v % 2 and lines:  # among words of the corpus
                    other = lines[rng.integers(len(lines))].split()
                    at = rng.integers(0, len(other) + 1)
                    head, tail = other[max(0, at - rng.integers(0, PIECE)) : at], other[at : at + rng.integers(0, PIECE)]
                else:
                    head, tail = (list(rng.choice(around, rng.integers(0, 5))) if v % 3 else [] for _ in range(2))
                texts.append(" ".join([*head, *kept, *tail]))
                labels.append(k)
    for _ in range(400):  # words of licences without their order are unknown, too
        pool = " ".join(rng.choice([s for t in TEMPLATES.values() for s in t], 3)).split()
        texts.append(" ".join(rng.permutation(pool)[: rng.integers(4, 14)]))
        labels.append(UNKNOWN)
    grams, _ = grams_of(*_buffer(texts))
    ids, y = _terms(grams, len(texts)), np.array(labels)
    order = rng.permutation(len(texts))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    w, seen, bias = np.zeros((1 << BITS, UNKNOWN + 1)), np.full((1 << BITS, UNKNOWN + 1), 1e-6), np.zeros(UNKNOWN + 1)
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            p = _softmax(w[ids[i]].sum(0) + bias)
            p[y[i]] -= 1
            g = p + 1e-4 * w[ids[i]]
            seen[ids[i]] += g * g
            w[ids[i]] -= 0.1 * g / np.sqrt(seen[ids[i]])
            bias -= 0.02 * p
    logits = np.array([w[ids[i]].sum(0) + bias for i in held])
    loss = lambda t: -np.mean([np.log(max(1e-12, _softmax(z / t)[y[i]])) for z, i in zip(logits, held, strict=True)])
    temperature = min((0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 5.0), key=loss)
    rows = np.flatnonzero(np.abs(w).sum(1))
    yield pa.RecordBatch.from_pydict({"bias": [bias.astype("<f8").tobytes()], "temperature": [temperature], "terms": [rows.astype("<i4").tobytes()], "weights": [w[rows].astype("<f4").tobytes()]})


def train_licenses(documents: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_lines: int = SAMPLE_LINES) -> dict:
    """The model; its unknown examples are at most `sample_lines` lines of `sample_texts` texts, both chosen by hash."""
    ids = documents.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_texts)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    lines = texts.select(F.explode(F.split("text", "[\r\n]+")).alias("text")).where("trim(text) != ''").distinct()
    sample = lines.orderBy(F.xxhash64("text"), "text").limit(sample_lines)
    sample = sample.unionByName(documents.sparkSession.createDataFrame([("",)], "text string"))  # an empty corpus trains, too
    return sample.repartition(1).sortWithinPartitions(F.xxhash64("text"), "text").mapInArrow(train, "bias binary, temperature double, terms binary, weights binary").first().asDict()


class Words:
    """The words of a chunk of texts: their hashes, and the text, paragraph, line and piece that each stands in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        low = hashing.LOWER[data]
        s, e = hashing.spans(hashing.ALNUM[low], offsets)
        self.h, self.text = hashing.span_hashes(hashing.prefix_sums(low), s, e), hashing.text_of(s, offsets)
        # Lines with anything but blanks, in order; a paragraph begins at a text's first line and after an empty or blank one.
        ls, le = hashing.spans(_LINE[data], offsets)
        blank = np.concatenate([[0], np.cumsum(hashing.NON_SPACE[data])])
        full = blank[le] > blank[ls]
        ls, le = ls[full], le[full]
        self.line_text = hashing.text_of(ls, offsets)
        ends = np.concatenate([[0], np.cumsum(data == 10)])  # a carriage return alone ends a line, too
        gap = ends[ls[1:]] - ends[le[:-1]] if len(ls) else ls
        opens = np.append(True, (self.line_text[1:] != self.line_text[:-1]) | (gap > 1))[: len(ls)]
        self.paragraph_of_line = np.cumsum(opens) - 1
        self.paragraphs = np.bincount(self.line_text[opens], minlength=len(offsets) - 1)
        self.line = np.searchsorted(ls, s, "right") - 1
        first = np.searchsorted(self.line, np.arange(len(ls)))
        nth = np.arange(len(s)) - first[self.line]
        cut = np.append(True, self.line[1:] != self.line[:-1])[: len(s)] | (nth % PIECE == 0)
        self.piece = np.cumsum(cut) - 1
        self.line_of_piece = self.line[cut]
        self.group = self.paragraph_of_line[self.line_of_piece]  # paragraph of each piece
        self.size = int(cut.sum())

    def grams(self, width: int, near: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """1- to 3-grams of windows of `width` pieces, with the piece that each window begins with; a gram once for each window that holds it.

        Only words of the pieces in `near` (all, if not given) are looked at.
        """
        at = np.arange(len(self.h)) if near is None else np.flatnonzero(near[self.piece])
        h, piece, out = self.h[at], self.piece[at], []
        for n in (1, 2, 3):
            g = hashing.ngrams(h, n)
            run = at[n - 1 :] - at[: len(g)] == n - 1 if len(g) else np.zeros(0, bool)
            g, low, high = g[run], piece[: len(g)][run], piece[n - 1 :][run] if len(g) else piece[:0]
            hashes, owners = [], []
            for back in range(width):
                begin = low - back
                ok = (begin >= 0) & (high < begin + width)
                ok[ok] = self.group[begin[ok]] == self.group[high[ok]]
                hashes.append(g[ok])
                owners.append(begin[ok])
            out.append((np.concatenate(hashes), np.concatenate(owners)))
        return out

    def near(self, templates: Templates) -> np.ndarray:
        """Pieces that a window with a template's 3-gram can hold."""
        g = hashing.ngrams(self.h, 3)
        hits = np.flatnonzero(templates.known[(g >> np.uint64(48)).astype(np.int64)])
        hits = hits[np.isin(g[hits], templates.grams)]
        flags = np.zeros(self.size, bool)
        for step in range(1 - WINDOW, WINDOW):
            flags[np.clip(np.concatenate([self.piece[hits], self.piece[hits + 2]]) + step, 0, self.size - 1)] = True
        return flags


def probabilities(ids: np.ndarray, owner: np.ndarray, count: int, model: dict) -> np.ndarray:
    """Calibrated probabilities of every class for `count` owners of distinct terms."""
    z = np.stack([np.bincount(owner, column[ids], count) for column in model["columns"]], axis=1) + model["bias"]
    z /= model["temperature"]
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _distinct(grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(np.concatenate([(o << BITS) | (hashing.mix(g + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64) for n, (g, o) in enumerate(grams)]))
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
    return key & ((1 << BITS) - 1), key >> BITS


def scanned_texts(data: np.ndarray, offsets: np.ndarray, model: dict, templates: Templates) -> tuple[np.ndarray, list[list[dict]]]:
    """Paragraphs of each text of a chunk, and the predictions in it."""
    words = Words(data, offsets)
    found: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    taken = np.zeros(words.size, bool)
    near = words.near(templates) if words.size else np.zeros(0, bool)
    for width in range(1, WINDOW + 1):
        if width > 1 and not near.any():
            break
        grams = words.grams(width, near if width > 1 else None)
        shares = templates.shares(*grams[2], words.size)
        if width > 1:  # a window longer than its paragraph is a smaller one
            wanted = np.zeros(words.size, bool)
            wanted[[p for p in shares if p + width <= words.size and words.group[p] == words.group[p + width - 1] and not taken[p : p + width].any()]] = True
            grams = [(g[wanted[o]], o[wanted[o]]) for g, o in grams]
        ids, owner = _distinct(grams)
        begins = owner[np.append(True, owner[1:] != owner[:-1])[: len(owner)]]
        if not len(begins):
            continue
        p = probabilities(ids, np.searchsorted(begins, owner), len(begins), model)
        best = p[:, :UNKNOWN].argmax(1)
        for k in np.flatnonzero(p[np.arange(len(best)), best] >= CUTOFF):
            begin, family = int(begins[k]), int(best[k])
            share = float(shares[begin][family]) if begin in shares else 0.0
            confirmed = share >= CONTAINED
            if width > 1 and (not confirmed or taken[begin : begin + width].any()):
                continue
            if confirmed:
                taken[begin : begin + width] = True
            line = words.line_of_piece[begin]
            text = int(words.line_text[line])
            found[text].append({"line": int(line - np.searchsorted(words.line_text, text)), "pieces": width, "family": FAMILIES[family], "probability": float(p[k, family]), "contained": share, "confirmed": confirmed})
    return words.paragraphs, found


def loaded(model: dict) -> dict:
    """The model with a dense column of weights for each class."""
    w = np.zeros((UNKNOWN + 1, 1 << BITS), np.float32)
    rows = np.frombuffer(model["terms"], "<i4")
    w[:, rows] = np.frombuffer(model["weights"], "<f4").reshape(-1, UNKNOWN + 1).T
    return {"columns": list(w), "bias": np.frombuffer(model["bias"], "<f8"), "temperature": model["temperature"]}


LICENSES = "array<struct<line:bigint,pieces:bigint,family:string,probability:double,contained:double,confirmed:boolean>>"


def scan(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_paragraphs, licenses array<struct<line, pieces, family, probability, contained, confirmed>>) for every whole text."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS rows of weights
    kind = pa.list_(pa.struct([("line", pa.int64()), ("pieces", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("contained", pa.float64()), ("confirmed", pa.bool_())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, templates = loaded(held.value), Templates()
        for batch in batches:
            data, offsets = common.text_buffer(batch.column("text"))
            counts, found = [np.zeros(0, np.int64)], []
            for _, _, part, cuts in common.chunks(data, offsets):
                n, licenses = scanned_texts(part, cuts, m, templates)
                counts.append(n)
                found += licenses
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(counts)), pa.array(found, kind)], ["doc_id", "n_paragraphs", "licenses"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scanned, f"doc_id long, n_paragraphs long, licenses {LICENSES}")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    found = scan(documents, train_licenses(documents))
    confirmed = F.filter("licenses", lambda x: x.confirmed)
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size(confirmed).cast("long").alias("n_licenses"),
        F.size("licenses").cast("long").alias("n_predicted"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(confirmed, lambda x: x.family))), ",").alias("families"),
        F.round(F.coalesce(F.array_max(F.transform(confirmed, lambda x: x.probability)), F.lit(0.0)), 6).alias("top_probability"),
    )
