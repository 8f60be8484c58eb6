"""Vector column functions."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docqa.functions.text import words


def as_float_array(c: Column) -> Column:
    return c.cast("array<float>")


SLICE_VALUES = 1 << 22  # counts that are made at once inside a batch


def _counts(found: pa.Array, dim: int) -> pa.Array:
    """Counts per bucket of each row's words: the first six hex digits of a word's MD5, modulo ``dim``. Each distinct word of the
    batch is hashed once."""
    lengths = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    coded = found.flatten().dictionary_encode()
    own = np.array([int.from_bytes(md5(w.encode()).digest()[:3], "big") % dim for w in coded.dictionary.to_pylist()], dtype=np.int64)
    buckets = own[coded.indices.to_numpy(zero_copy_only=False)]
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    step, parts = max(1, SLICE_VALUES // dim), []
    for lo in range(0, len(lengths), step):
        hi = min(lo + step, len(lengths))
        places = np.repeat(np.arange(hi - lo) * dim, lengths[lo:hi]) + buckets[ends[lo] : ends[hi]]
        parts.append(np.bincount(places, minlength=(hi - lo) * dim).astype(np.float32))
    values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.float32))
    offsets = pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, values, mask=found.is_null() if found.null_count else None)


def hash_counts(text: Column, dim: int) -> Column:
    """Word counts per bucket as ``array<float>`` of length ``dim``; null for a null text.

    The words are found by a column expression and counted by whole Arrow batches, so the row stays in its partition; nothing is
    exploded or shuffled.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType(), containsNull=False))
    def count(found: pa.Array) -> pa.Array:
        return _counts(found, dim)

    return count(words(text))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
