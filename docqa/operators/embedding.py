"""Text to vectors. An encoder has ``name``, ``dim`` and ``column(text)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docqa.functions.text import let
from docqa.functions.vectors import hash_counts, norm

VECTOR_TYPE = T.ArrayType(T.FloatType(), containsNull=False)


@dataclass(frozen=True)
class HashEncoder:
    """Built-in encoder: word counts in hashed buckets, found by a column expression and counted by Arrow batches."""

    dim: int = 256

    @property
    def name(self) -> str:
        return f"hash-{self.dim}"

    def column(self, text: Column) -> Column:
        return hash_counts(text, self.dim)


@dataclass(frozen=True)
class BatchEncoder:
    """A model hook. ``make_fn`` loads the model once per Python worker and returns
    a function from an array of texts to a float matrix."""

    name: str
    dim: int
    make_fn: Callable[[], Callable[[np.ndarray], np.ndarray]]
    batch_size: int = 32

    def column(self, text: Column) -> Column:
        encode = predict_batch_udf(
            self.make_fn, return_type=T.ArrayType(T.FloatType()), batch_size=self.batch_size
        )
        return encode(text)


def embed(df: DataFrame, text: str, encoder, vector: str = "embedding") -> DataFrame:
    """Add the vector of each text. Row-local: no join and no dependence on row order."""
    return df.withColumn(vector, encoder.column(F.col(text)))


def _bucket_texts(counted: DataFrame, dim: int) -> DataFrame:
    """``(bucket, n)``: how many texts hold each bucket, and how many there are as bucket -1. A task gives one sum of each."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(dim + 1, dtype=np.int64)
        for batch in batches:
            vectors = batch.column(0)
            held[:dim] += np.count_nonzero(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), axis=0)
            held[dim] += batch.num_rows - vectors.null_count
        some = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.where(some < dim, some, -1), pa.int32()), pa.array(held[some])], names=["bucket", "n"])

    return counted.mapInArrow(total, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def tfidf_embed(df: DataFrame, text: str, dim: int = 256, vector: str = "embedding") -> DataFrame:
    """Hashed word counts weighted by ``ln((n + 1) / (df + 1))`` and scaled to length one.

    The bucket weights are one array of length ``dim`` and reach the rows as a scalar subquery.
    """
    counted = df.withColumn("_tf", hash_counts(F.col(text), dim))
    seen = _bucket_texts(counted.select("_tf"), dim)
    held = seen.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("held"))  # at most dim + 1 entries
    of = lambda b: F.coalesce(F.try_element_at("held", b), F.lit(0))
    weights = held.select(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.log((of(F.lit(-1)) + 1) / (of(b) + 1)))).scalar()
    weighted = F.zip_with("_tf", "_idf", lambda tf, w: tf * w)

    def unit_length(w):
        return let(
            norm(w), lambda n: F.transform(w, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float"))
        )

    return counted.withColumn("_idf", weights).withColumn(vector, let(weighted, unit_length)).drop("_tf", "_idf")
