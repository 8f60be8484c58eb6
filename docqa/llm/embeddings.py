"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docqa.llm.common import by_unit, components, in_blocks, local_roots, spread, table
from docqa.workspace import settle

COSINE = 0.93
# A pair at cosine 0.93 (distance 0.374) meets in one projection of width 2 with probability 0.85, in one table of 8 with
# 0.27, in one of 24 tables with 0.9995; closer pairs meet more surely.
TABLES, PROJECTIONS, WIDTH = 24, 8, 2.0


def bucket_keys(vectors: np.ndarray, seed: int = 11) -> np.ndarray:
    """One 32-bit key for each unit vector and table: its quantised random projections, hashed; a clash only adds candidates."""
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((vectors.shape[1], TABLES * PROJECTIONS))
    b = rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    mix = rng.integers(1, 1 << 63, (TABLES, PROJECTIONS), dtype=np.uint64) | np.uint64(1)
    cells = np.floor((vectors @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(-1, TABLES, PROJECTIONS)
    return ((cells * mix).sum(axis=2, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _units(column) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the vectors of an Arrow list column, and the vectors scaled to length one as rows filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.zeros((len(size), size.max(initial=0)))
    x[np.arange(x.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        norm = np.linalg.norm(x, axis=1, keepdims=True)
    odd = np.nonzero(~np.isfinite(norm[:, 0]) | (norm[:, 0] < 1e-100))[0]
    if len(odd):  # squares that double precision can't hold
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
        norm[odd] = np.linalg.norm(x[odd], axis=1, keepdims=True)
    return size, x / norm


def _hashed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, x = _units(batch.column(batch.schema.get_field_index("vec")))
            keys = np.zeros((len(size), TABLES), np.int32)
            for dim in np.unique(size).tolist():
                own = size == dim
                keys[own] = bucket_keys(x[own, :dim])
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * TABLES, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def _compare(least: float):
    def work(unit: pa.Table) -> pa.Table:
        """For each class with links first found in this table: its links, and the smallest class here that it reaches."""
        first = unit.slice(0, 1).to_pylist()[0]
        (_, low, high), t = first["unit"], first["t"]
        cid, n, label, side = (unit.column(c).to_numpy() for c in ("cid", "n", "label", "side"))
        dim, x = _units(unit.column("vec"))
        cells = unit.column("cells").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
        left = np.nonzero(side == low)[0]
        right = left if low == high else np.nonzero(side == high)[0]
        found = []
        for at in range(0, len(left), 256):
            a = left[at : at + 256]
            i, j = np.nonzero(x[a] @ x[right].T >= least)
            i, j = a[i], right[j]
            keep = (label[i] == label[j]) & (dim[i] == dim[j]) & ((i < j) | (low != high))
            i, j = i[keep], j[keep]
            for earlier in range(t):  # a pair counts in the first table where it meets
                new = cells[i, earlier] != cells[j, earlier]
                i, j = i[new], j[new]
            found.append((i, j))
        i, j = (np.concatenate(p) for p in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
        links = np.zeros(len(cid), np.int64)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        root, some = local_roots(len(cid), i, j), links > 0
        return pa.table({"u": cid[some], "v": cid[root[some]], "links": links[some]})

    return work


def near_duplicates(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (vec_id, embedding, label).

    Equal vectors of a label are one class, so copies are counted, not compared; a bucket of many classes is compared in
    blocks. Links need equal labels that are not null, and equal lengths. Vectors are compared as they
    are given, floats or doubles. Null, empty and zero vectors, vectors with a null or
    non-finite component, and null labels link with nothing. Repeated rows are copies; a null vec_id is never a component's
    id unless alone. An empty table gives none. Other columns are not read.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = vectors.schema["embedding"].dataType
    wide = "double" if not isinstance(kind, T.ArrayType) or isinstance(kind.elementType, T.DoubleType) else "float"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{wide}>").alias("vec"), F.col("label").cast("long").alias("label"))
    valid = F.coalesce(finite & F.exists("vec", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    rows = rows.withColumn("valid", valid)
    classes = rows.filter("valid").groupBy("label", "vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    classes = settle(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    hashed = settle(_hashed(spread(classes.select("cid", "n", "label", "vec"))), "hashed")
    # Buckets are counted and cut without vectors; those join only the rows that share a bucket with another.
    cells = hashed.select("cid", "label", F.posexplode("cells").alias("t", "cell"))
    cells = cells.select("cid", "t", F.xxhash64("label", "t", "cell").alias("bucket"))
    units = in_blocks(cells, "bucket", F.col("cid")).drop("bucket")
    found = settle(by_unit(units.join(hashed, "cid"), _compare(least), "u long, v long, links long"), "found")
    links = found.groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(found.select("u", "v").filter("u <> v"))
    known = classes.join(links, "cid", "left").join(roots, classes["cid"] == roots["node"], "left")
    known = known.select("label", "vec", "first", F.coalesce("root", "cid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    lowest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = known.join(lowest, "root").select("label", "vec", "n_links", "component_id")
    out = rows.filter("valid").join(ids, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def op4_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embeddings": op4_embeddings}
