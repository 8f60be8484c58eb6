"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docqa.llm.common import table

SHINGLE = 5
CONTAINED = 0.8
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# One row a band: a window twice as wide as a template's class holds at least a fifth of the joint shingles, so that one of the
# 32 bands meets with probability 1 - 0.8 ** 32 = 0.9992 at least. Templates of one shingle meet surely.
BANDS = 32
# The notices that are searched, in their usual words.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
    'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:",
}


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


PLACES, ROWS = _odd(SHINGLE, 3), _odd(BANDS, 4)


def _plain(word: bytes) -> bytes:
    """A word without the ASCII signs at its edges; nothing is left of comment markers and the like."""
    return word.strip(SIGNS) if word.isascii() or any(c.isalnum() for c in word.decode("utf-8", "replace")) else b""


def _hashes(words: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each shingle of five plain words, none for fewer; and the places of the plain words among all words."""
    for w in set(words).difference(known):
        plain = _plain(w)
        known[w] = (xxhash.xxh64_intdigest(plain) or 1) if plain else 0
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    places = np.nonzero(h)[0]
    h, n = h[places], len(places) - SHINGLE + 1
    return sum(h[k : k + n] * PLACES[k] for k in range(SHINGLE)) if n > 0 else np.zeros(0, np.uint64), places


def _permuted(h: np.ndarray, band: int) -> np.ndarray:
    x = h * ROWS[band]
    return (x ^ (x >> np.uint64(29))) * ROWS[(band + 1) % BANDS]


class Index:
    """Templates by class of size; the bands of each class; the exact shingles of each template."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.shingles, self.bands = [], {}
        for i, text in enumerate(templates.values()):
            words = [p for w in text.encode().lower().split() if (p := _plain(w))]
            h, _ = _hashes(words, {})
            if not len(h):
                raise ValueError(f"template {self.names[i]} has fewer than {SHINGLE} words")
            self.shingles.append({tuple(words[k : k + SHINGLE]) for k in range(len(h))})
            size = 1 if len(h) == 1 else max(4, 1 << (len(h) - 1).bit_length())
            bands = self.bands.setdefault(size, [{} for _ in range(BANDS)])
            for b in range(BANDS):
                bands[b].setdefault(int(_permuted(h, b).min()), []).append(i)
        self.values = {size: [np.array(sorted(b), dtype=np.uint64) for b in bands] for size, bands in self.bands.items()}
        own = [_hashes(t.encode().lower().split(), {})[0] for t in templates.values()]
        self.minima = np.unique(np.concatenate([h[[_permuted(h, b).argmin() for b in range(BANDS)]] for h in own]))
        self.widest = max(self.bands)

    def candidates(self, h: np.ndarray) -> set[tuple[int, int, int]]:
        """Template, first shingle and end shingle of each window that shares a band with it.

        The permutations are one-to-one, so a window's minimum in a band is a template's only if the window holds the very shingle
        that is the template's minimum. These shingles, at most ``BANDS`` a template, are looked up once, and the bands are
        taken only of the windows around them: the bands that meet are the same ones.
        """
        place = np.minimum(np.searchsorted(self.minima, h), len(self.minima) - 1)
        block = np.unique(np.nonzero(self.minima[place] == h)[0] // self.widest)
        if not len(block):
            return set()
        block = np.unique(np.concatenate([block - 1, block, block + 1]))
        block = block[block >= 0]
        out = set()
        for run in np.split(block, np.nonzero(np.diff(block) > 1)[0] + 1):
            at = int(run[0]) * self.widest
            part = h[at : (int(run[-1]) + 1) * self.widest]
            out.update((i, a + at, b + at) for i, a, b in self._met(part)) if len(part) else None
        return out

    def _met(self, h: np.ndarray) -> set[tuple[int, int, int]]:
        out = set()
        for band in range(BANDS):
            x = _permuted(h, band)
            if band == 0 and 1 in self.bands:
                for at in np.nonzero(np.isin(x, self.values[1][0]))[0].tolist():
                    out.update((i, at, at + 1) for i in self.bands[1][0][int(x[at])])
            low, width = np.minimum.reduceat(x, np.arange(0, len(x), 4)), 4
            for size in sorted(s for s in self.bands if s > 1):
                while width < size:  # windows of a class are two neighbouring blocks of its size
                    low, width = np.minimum.reduceat(low, np.arange(0, len(low), 2)), 2 * width
                wide = np.minimum(low, np.append(low[1:], low[-1]))
                for at in np.nonzero(np.isin(wide, self.values[size][band]))[0].tolist():
                    out.update((i, at * size, min(len(h), (at + 2) * size)) for i in self.bands[size][band][int(wide[at])])
        return out

    def matches(self, raw: bytes, known: dict[bytes, int]) -> list[tuple[int, int, int]]:
        """Template, first word and end word of each verified match; overlapping matches of a template are one.

        Words are counted as they stand, comment markers too.
        """
        words = raw.lower().split()
        h, places = _hashes(words, known)
        found: dict[int, list[list[int]]] = {}
        for i, a, b in sorted(self.candidates(h)) if len(h) else ():
            wanted = self.shingles[i]
            plain = [_plain(words[p]) for p in places[a : b + SHINGLE - 1].tolist()]
            met = {k: x for k in range(a, b) if (x := tuple(plain[k - a : k - a + SHINGLE])) in wanted}
            if len(set(met.values())) >= CONTAINED * len(wanted):
                first, end, own = int(places[min(met)]), int(places[max(met) + SHINGLE - 1]) + 1, found.setdefault(i, [])
                if own and first < own[-1][1]:
                    own[-1][1] = max(end, own[-1][1])
                else:
                    own.append([first, end])
        return [(i, a, b) for i in sorted(found) for a, b in found[i]]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id`` and ``found`` (license, first_word, end_word) of every whole text, by template and place.

    Null, empty and short texts have no match; repeated rows stay; an empty table gives none; other columns are not read.
    The template index is as large as ``templates``, not as the input, and goes to every task.
    """
    KEEP = 500_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = Index(templates), {}
        kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
        for batch in batches:
            rows = []
            for x in batch.column("raw"):
                if len(known) > KEEP:
                    known.clear()
                rows.append([{"license": index.names[i], "first_word": a, "end_word": b} for i, a, b in index.matches(x.as_py() or b"", known)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "found"])

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return raw.mapInArrow(run, "doc_id long, found array<struct<license:string,first_word:long,end_word:long>>")


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    text = F.transform("found", lambda x: F.concat_ws(":", x["license"], x["first_word"], x["end_word"]))
    made = scan(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.size("found").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"), F.array_join(text, ",").alias("matches"))


QUERIES = {"op2_licenses": op2_licenses}
