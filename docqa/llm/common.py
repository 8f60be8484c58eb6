"""Helpers that the training-data operators share: row keys, connected components, comparison of bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docqa.workspace import settle

BLOCK = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def column(name: str) -> Column:
    """A column by its plain name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows dealt evenly before costly work on each; never used on texts."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node with a link; ``links`` has long columns ``u, v``.

    Large-star and small-star rounds. Each round keeps minima by partial aggregation and rewires links by a join, so a hub
    with many links is never gathered; rounds are written to the shared folder, so lineage is cut. No links give no rows.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = settle(edges, "links")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(pairs.select("u", F.col("m").alias("v")))
        edges = settle(small.filter("u <> v").distinct(), "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def in_blocks(rows: DataFrame, key: str, unique: Column, block: int = BLOCK) -> DataFrame:
    """Rows of a key in comparison units of at most about two blocks; any two rows of a key meet in exactly one unit.

    Adds ``unit`` (long array of key, lower block, upper block) and ``side`` (the row's own block). A key of up to ``block``
    rows is one unit. A larger one is cut into blocks by a hash, and each pair of blocks is a unit.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > 1)
    parts = rows.join(sizes, key).withColumn("__b", F.ceil(F.col("__n") / block).cast("long"))
    parts = parts.withColumn("side", F.pmod(F.xxhash64(unique, F.lit("block")), F.col("__b")))
    parts = parts.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__b") - 1)))
    unit = F.array(F.col(key), F.least("side", "__o"), F.greatest("side", "__o"))
    return parts.withColumn("unit", unit).drop("__n", "__b", "__o")


def by_unit(df: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run ``work`` once for each unit; units are sorted inside a partition and taken from the stream of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def flush():
            if held and sum(x.num_rows for x in held) > 1:
                yield from work(pa.Table.from_batches(held)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            cuts = [0, *(i + 1 for i in (unit[1:] != unit[:-1]).any(axis=1).nonzero()[0].tolist()), len(unit)]
            for a, b in zip(cuts, cuts[1:]):
                if tuple(unit[a]) != last:
                    yield from flush()
                    last, held = tuple(unit[a]), []
                held.append(batch.slice(a, b - a))
        yield from flush()

    return df.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, schema)


def local_roots(n: int, a, b):
    """Smallest index that each of n items reaches by the links (a[i], b[i])."""
    import numpy as np

    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low
