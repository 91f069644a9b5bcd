"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A template of n shingles (``k`` words in a row) is looked for with windows of the largest power of two that fits into n,
moved by a quarter of their length. Window minima of all lengths come from the same hash values by doubling: the minimum
over 2w shingles is the smaller of two minima over w. Bands are compared with the bands of all windows of the templates
(every place, so an intact copy always has an equal window whatever the stride). Windows of fewer than 8 shingles have 48
bands of one sample, longer ones 24 bands of two: two windows of Jaccard similarity 1/2 share no band with probability
2^-48 = 4e-15 and (3/4)^24 = 0.001, of 1/3 (each holds half of the other) with (2/3)^48 = 4e-9 and (8/9)^24 = 0.06. A copy
has several windows on the stride, each with its own chance.

Every retrieved place is verified exactly: the share of the template's distinct shingles that occur in the text around
the window must reach ``containment``. Texts are scanned whole in one pass without a shuffle.

Edge cases: null and empty texts match nothing; a template of fewer than ``k`` words is refused. The best place of a
template in a text is reported, the earliest on ties. Repeated rows give repeated rows; null ids are carried. An empty
table gives an empty result; other columns are ignored, whatever their names. Very long texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .scratch import text_batches

SAMPLES = 48
WORDS = 5
#: Opening or characteristic passages of well-known licenses.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


def _doubled(held: np.ndarray, w: int) -> np.ndarray:
    """Minima over ``2 w`` values from minima over ``w`` (past the end nothing is smaller)."""
    out = held.copy()
    np.minimum(held[:-w], held[w:], out=out[:-w])
    return out


class Templates:
    """Shingles of the templates and, for each window length, sorted band keys of their windows."""

    def __init__(self, texts: dict[str, str], k: int, samples: int = SAMPLES):
        self.k, self.samples, self.names = k, samples, list(texts)
        data, offsets = W.text_bytes(pa.array(list(texts.values()), pa.string()))
        w = W.words(data, offsets)
        if texts and np.diff(w.rows).min() < k:
            raise ValueError(f"a template has fewer than {k} words")
        values, at = W.shingles(w, k)
        self.sets = [np.unique(values[at[i] : at[i + 1]]) for i in range(len(texts))]
        self.lengths = np.diff(at)
        self.width = [1 << (int(n).bit_length() - 1) for n in self.lengths]
        seeds = W.mix(np.arange(1, samples + 1, dtype=np.uint64))
        self.factor, self.shift = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1), seeds.astype(np.uint32)
        self.index = {}
        for width in sorted(set(self.width)):
            keys, owners = [], []
            for i in [i for i, own in enumerate(self.width) if own == width]:
                own = values[at[i] : at[i + 1]]
                mins = self.minima(own, [width])[width][:, : len(own) - width + 1]
                for key in self.keys(mins, width):
                    keys.append(key)
                    owners.append(np.full(len(key), i))
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            low = np.zeros(1 << 18, bool)
            low[(keys & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
            self.index[width] = (keys[order], owners[order], low)

    def minima(self, values: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
        """For each window length, (samples, shingles) smallest hash from each shingle on."""
        x = (values >> np.uint64(32)).astype(np.uint32)
        out = {width: np.empty((self.samples, len(x)), np.uint32) for width in widths}
        for s in range(self.samples):
            held, width = (x * self.factor[s]) ^ self.shift[s], 1
            while True:
                if width in out:
                    out[width][s] = held
                if width >= max(widths) or width >= len(held):
                    break
                held, width = _doubled(held, width), width * 2
            for longer in widths:
                if longer > width:
                    out[longer][s] = held
        return out

    def keys(self, mins: np.ndarray, width: int) -> Iterator[np.ndarray]:
        """Band keys of windows: one sample in a band, two for windows of 8 shingles and more."""
        rows = 1 if width < 8 else 2
        for b in range(0, self.samples - rows + 1, rows):
            key = mins[b].astype(np.uint64)
            if rows == 2:
                key = (key << np.uint64(32)) | mins[b + 1]
            yield W.mix(key * np.uint64(self.samples) + np.uint64(b))

    def candidates(self, values: np.ndarray) -> list[tuple[int, int]]:
        """(template, first shingle of the window) for windows that share a band."""
        found = set()
        widths = list(self.index)
        mins = self.minima(values, widths)
        for width in widths:
            known, owners, low = self.index[width]
            stride = max(1, width // 4)
            for key in self.keys(mins[width][:, ::stride], width):
                at = np.flatnonzero(low[(key & np.uint64((1 << 18) - 1)).astype(np.int64)])
                if len(at):
                    lo, hi = np.searchsorted(known, key[at], "left"), np.searchsorted(known, key[at], "right")
                    for j in np.flatnonzero(hi > lo):
                        found |= {(int(o), int(at[j]) * stride) for o in set(owners[lo[j] : hi[j]].tolist())}
        return sorted(found)

    def share(self, template: int, around: np.ndarray) -> float:
        own = self.sets[template]
        return float(np.isin(own, around).sum()) / len(own)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, words: int = WORDS, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id, containment, start_word, end_word of every template found in every text."""
    held = Templates(templates, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for row, end, data, offsets in W.slices(batch.column(1), 1 << 18):
                w = W.words(data, offsets)
                values, at = W.shingles(w, words)
                if not len(values):
                    continue
                for template, place in held.candidates(values):
                    d = int(np.searchsorted(at, place, "right")) - 1
                    n = int(held.lengths[template])
                    lo, hi = max(int(at[d]), place - n), min(int(at[d + 1]), place + 2 * n)
                    share = held.share(template, values[lo:hi])
                    if share >= containment and share > best.get((row + d, template), (0.0,))[0]:
                        inside = lo + np.flatnonzero(np.isin(values[lo:hi], held.sets[template]))
                        best[row + d, template] = (share, int(inside[0] - at[d]), int(inside[-1] - at[d]) + words)
            found = [(batch.column(0)[d].as_py(), held.names[t], *best[d, t]) for d, t in sorted(best)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "license_id", "containment", "start_word", "end_word"])

    text_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, license_id string, containment double, start_word bigint, end_word bigint")
