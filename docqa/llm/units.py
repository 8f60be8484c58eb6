"""Texts as rows of remembered units (words with what surrounds them), so that a tokenizer sees each unit once."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level entries: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ragged(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of integers as one array, and their sizes."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum())), sizes


class Ragged:
    """Rows of integers of unlike lengths, end to end in one growing array."""

    def __init__(self):
        self.flat, self.start, self.n = np.zeros(1 << 14, np.int32), np.zeros(1 << 12, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        a, total, n = int(self.start[self.n]), len(flat), len(sizes)
        while a + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + n + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[a : a + total] = flat
        self.start[self.n + 1 : self.n + 1 + n] = a + np.cumsum(sizes)
        self.n += n

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``at`` end to end, and their sizes."""
        sizes = self.start[at + 1] - self.start[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[at] - ends + sizes, sizes) + np.arange(total)], sizes


class Units:
    """Numbers of units; ``encode`` gives a pair (all integers end to end, how many for each unit) in each of ``columns`` ragged
    columns for a list of new units.

    What is remembered is dropped before a call once it holds over ``keep`` units or ``most`` numbers.
    """

    def __init__(self, encode: Callable[[list[str]], list[tuple]], columns: int, keep: int = 600_000, most: int = 8_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.encode, self.columns, self.keep, self.most = encode, columns, keep, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = [Ragged() for _ in range(self.columns)]

    def numbers(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts end to end as row numbers, and how many each text has."""
        if len(self.known) > self.keep or any(r.start[r.n] > self.most for r in self.rows):
            self.clear()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        units = list(chain.from_iterable(texts))
        at = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        missing = np.nonzero(at < 0)[0].tolist()
        if missing:
            met = [units[i] for i in missing]
            new = list(dict.fromkeys(met))
            for column, made in zip(self.rows, self.encode(new)):
                column.add(*made)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            at[missing] = [self.known[u] for u in met]
        return at, sizes


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose strings in ``column`` hold at most ``most`` bytes together, or of one row."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        at, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > at and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if batch.num_rows > at:
            yield batch.slice(at)
