"""Nearest rows by k-means cells: each question probes cells in order of distance until the triangle inequality proves its k best.

A cell is a centroid, the number of its rows and its radius, the largest distance of a row from the centroid. No row of a cell is
nearer to a question than the centroid's distance less the radius, so a cell beyond a question's k-th best can be left out.
Distances are between unit vectors for ``cosine``, between the vectors themselves for ``l2``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docqa.operators.retrieval import (
    INDEX_BLOCK_ROWS,
    SCORE_ROWS,
    TASKS_PER_CORE,
    _all_blocks,
    _BestK,
    _grid,
    _hit_type,
    _hits,
    _matrix,
    _own_block,
    best_hits,
    rank_hits,
)
from docqa.workspace import new_folder, settle

METRICS = ("cosine", "l2")
SAMPLE_ROWS = 64  # rows a cell that the centroids are fitted on, taken by a hash of the key; all rows are assigned
CENTROID_BYTES = 64 << 20  # bound of the centroids, which go to every task; beyond it cells hold more rows
ROUNDS = 12  # of k-means
SLACK = 1e-9  # far above what rounding does to a distance of vectors of length one
BLOCK_ROWS = 4096  # questions of a block and rows of a slice that are worth a task
PLACE_ROWS = 512  # questions whose cells are found together
NO_DIRECTION = -1  # the cell of vectors of length zero under cosine


@dataclass(frozen=True)
class Cells:
    """Rows ``(key, vector, cell)`` laid out by cell, and the cells' centroids, row counts and radii."""

    rows: DataFrame
    metric: str
    numbers: np.ndarray
    centroids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray


def cell_count(rows: int, dim: int) -> int:
    """Cells of an index: the square root of its rows, as far as the centroids stay within their bound."""
    return max(1, min(math.isqrt(rows), CENTROID_BYTES // (8 * max(1, dim))))


def directed(vectors: np.ndarray, metric: str) -> np.ndarray:
    """The points that distances are taken between; a vector of length zero stays as it is."""
    if metric != "cosine":
        return vectors
    largest = np.abs(vectors).max(axis=1, keepdims=True, initial=0.0)
    vectors = np.divide(vectors, largest, out=np.zeros_like(vectors), where=largest > 0)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * points @ centroids.T
    return np.sqrt(np.maximum(squares, 0.0))


def fit_centroids(points: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """k-means: rows far from one another as a start, then ``ROUNDS`` of means; a cell without rows gets the farthest row."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(n, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        apart = distances(points, centroids)
        own = apart.argmin(axis=1)
        held = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        far = np.argsort(-apart[np.arange(len(points)), own], kind="stable")
        empty = np.nonzero(held == 0)[0]
        centroids = sums / np.maximum(held, 1)[:, None]
        centroids[empty] = points[far[: len(empty)]]
    return np.unique(centroids, axis=0)


def build_cells(
    rows: DataFrame, path: str, metric: str = "cosine", key: str = "chunk_key", vector: str = "embedding", cells: int | None = None
) -> Cells:
    """Write ``rows`` in folders by cell below ``path``, and the table of cells beside them.

    The centroids are fitted on the driver, on at most ``SAMPLE_ROWS`` rows a cell; every row is then assigned to its nearest
    centroid. A crowded cell is written by as many tasks as its sampled share asks for.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark, x = rows.sparkSession, rows.select(key, vector)
    total = x.count()
    dim = (x.select(F.size(vector)).first() or [0])[0]
    n = cells or cell_count(total, dim)
    sample = x.orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS * n).toArrow() if total else None
    points = directed(_matrix(sample.column(1)), metric) if sample is not None and sample.num_rows else np.zeros((0, dim))
    if metric == "cosine":
        points = points[points.any(axis=1)]
    centroids = fit_centroids(points, n) if len(points) else np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = directed(_matrix(batch.column(1)), metric)
                apart = distances(points, shared.value)
                own = apart.argmin(axis=1)
                away = np.linalg.norm(points - shared.value[own], axis=1)
                if metric == "cosine":
                    zero = ~points.any(axis=1)
                    own[zero], away[zero] = NO_DIRECTION, 0.0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(away)], names=[key, vector, "cell", "away"])

    schema = T.StructType([*x.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    assigned = settle(x.mapInArrow(assign, schema), "assigned")
    held = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    known = held.toPandas().sort_values("cell")  # one row a cell
    numbers = known["cell"].to_numpy(dtype=np.int64)
    places = np.concatenate([centroids, np.zeros((1, dim))])[numbers]
    table = [(int(c), int(m), float(r), [float(v) for v in p]) for c, m, r, p in zip(numbers, known["n"], known["radius"], places)]
    spark.createDataFrame(table, "cell int, n long, radius double, centroid array<double>").coalesce(1).write.parquet(f"{path}/cells")
    pieces = F.create_map(*[F.lit(v) for c, m in zip(numbers, known["n"]) for v in (int(c), math.ceil(m / INDEX_BLOCK_ROWS))]) if table else F.create_map(F.lit(0), F.lit(1))
    salt = F.pmod(F.xxhash64(key), F.element_at(pieces, F.col("cell")))
    assigned.drop("away").repartition("cell", salt).write.partitionBy("cell").parquet(f"{path}/rows/metric={metric}")
    return read_cells(spark, path, x.schema)


def read_cells(spark: SparkSession, path: str, schema: T.StructType | None = None) -> Cells:
    known = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("metric", T.StringType())])) if schema else spark.read
    rows = reader.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    made_for = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/metric=*")
    metric = str(made_for.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(made_for)[0].getPath()).rpartition("=")[2]
    dim = len(known["centroid"][0]) if len(known) else 0
    return Cells(
        rows.drop("metric"), metric, known["cell"].to_numpy(dtype=np.int64), np.array(known["centroid"].tolist()).reshape(len(known), dim),
        known["n"].to_numpy(dtype=np.int64), known["radius"].to_numpy(dtype=float),
    )


def open_cells(points: np.ndarray, bound: np.ndarray, cells: tuple, high: int, some: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Which of the cells (those at the places ``some``) may hold one of the k best of each point and are among its ``high`` nearest."""
    numbers, centroids, radii, metric = cells
    zero = ~points.any(axis=1) if metric == "cosine" else np.zeros(len(points), dtype=bool)
    bound = np.where(zero, np.inf, bound)
    if high >= len(numbers):
        numbers, centroids, radii = numbers[some], centroids[some], radii[some]
    apart = distances(points, centroids)
    if metric == "cosine":
        apart[:, numbers == NO_DIRECTION] = math.sqrt(2.0)  # no cosine but zero
        apart[zero] = 0.0
    scale = 1.0 if metric == "cosine" else 1.0 + np.abs(points).max(initial=0.0) + np.abs(cells[1]).max(initial=0.0)
    found = apart - radii <= (bound + SLACK * scale + 2e-8 * scale)[:, None]
    if high < len(cells[0]):
        near = np.zeros_like(found)
        np.put_along_axis(near, np.argsort(apart, axis=1, kind="stable")[:, :high], True, axis=1)
        found = (found & near)[:, some]
    return found


def _asks(asked: DataFrame, cells: tuple, vector: str, high: int) -> dict[int, int]:
    """Number of questions that each cell has to be scored for; a task gives one sum a cell."""
    shared = asked.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, _, _, metric = shared.value
        asks = np.zeros(len(numbers), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, PLACE_ROWS):
                own = batch.slice(at, PLACE_ROWS)
                bound = _distances_of(own.column(1).to_numpy(zero_copy_only=False), metric)
                asks += open_cells(directed(_matrix(own.column(0)), metric), bound, shared.value, high).sum(axis=0)
        some = np.nonzero(asks)[0]
        yield pa.RecordBatch.from_arrays([pa.array(numbers[some], pa.int32()), pa.array(asks[some])], names=["cell", "n"])

    counted = asked.select(vector, "least").mapInArrow(run, "cell int, n bigint")
    return {r[0]: r[1] for r in counted.groupBy("cell").agg(F.sum("n")).collect()}  # one row a cell


def _deal(cells: tuple, sizes: np.ndarray, asks: dict[int, int], slices: int) -> tuple[list[tuple[int, list[int]]], list[np.ndarray]]:
    """The slices that each cell's rows go to, and the places of each slice's cells.

    Cells go to the slice with the least pairs so far, the costliest first; one that is more than a slice's share goes to several.
    """
    numbers = cells[0]
    pairs = np.array([asks.get(int(c), 0) for c in numbers], dtype=float) * sizes
    share = max(pairs.sum() / slices, 1.0)
    load, routes, held = [(0.0, s) for s in range(slices)], [], [[] for _ in range(slices)]
    for i in np.argsort(-pairs, kind="stable"):
        if pairs[i]:
            parts = min(slices, math.ceil(pairs[i] / share))
            taken = [heapq.heappop(load) for _ in range(parts)]
            for had, s in taken:
                heapq.heappush(load, (had + pairs[i] / parts, s))
                held[s].append(i)
            routes.append((int(numbers[i]), [s for _, s in taken]))
    return routes, [np.array(sorted(h), dtype=np.int64) for h in held]


def _round(
    asked: DataFrame, cells: Cells, asks: dict[int, int], hit_type: T.StructType, k: int, high: int, blocks: int, slices: int
) -> DataFrame:
    """The k best of every pair of question block and slice of the cells, from the ``high`` nearest cells that are open.

    A question goes once to each slice, however many of its cells lie there, and a row once to each block. The task finds the cells
    of its questions again, and leaves out those that the best rows it has seen rule out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, schema = asked.sparkSession, to_arrow_schema(hit_type)
    (query_key, vector, _), index_key = asked.columns, cells.rows.columns[0]
    order = (cells.numbers, cells.centroids, cells.radii, cells.metric)
    routes, held = _deal(order, cells.sizes, asks, slices)
    shared = spark.sparkContext.broadcast((order, held))
    none = lambda t: F.lit(None).cast(t)
    own, copy = F.col("_own"), F.col("_copy")
    q = asked.select("*", _own_block(query_key, blocks).alias("_own"), _all_blocks(slices).alias("_copy")).select(
        (own * slices + copy).alias("_place"), F.lit(-2).alias("_cell"), F.col(query_key).alias("_q"), none(hit_type[index_key].dataType).alias("_x"),
        F.col(vector).alias("_v"), "least",
    )
    to = F.broadcast(spark.createDataFrame(routes, "cell int, _slices array<int>"))
    slice_of = F.element_at("_slices", F.pmod(F.xxhash64(index_key), F.size("_slices")).cast("int") + 1)
    x = cells.rows.filter(F.col("cell").isin([c for c, _ in routes])).join(to, "cell").select("*", slice_of.alias("_own"), _all_blocks(blocks).alias("_copy"))
    x = x.select(
        (copy * slices + own).alias("_place"), F.col("cell").alias("_cell"), none(hit_type[query_key].dataType).alias("_q"), F.col(index_key).alias("_x"),
        F.col(vector).alias("_v"), none("double").alias("least"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (numbers, _, _, metric), held = shared.value
        place = best = None
        asking: list[pa.RecordBatch] = []

        def hits() -> Iterator[pa.RecordBatch]:
            if best is not None:
                yield from _hits(best, pa.concat_arrays([b.column(2) for b in asking]), schema).to_batches()

        for batch in batches:
            mark, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.nonzero((np.diff(mark) != 0) | (np.diff(cell) != 0))[0] + 1, [len(mark)]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                rows = batch.slice(lo, hi - lo)
                if mark[lo] != place:
                    yield from hits()
                    place, asking, best = mark[lo], [], None
                if cell[lo] == -2:
                    asking.append(rows)
                    continue
                if not asking:
                    continue
                if best is None:
                    mine = held[int(place) % slices]
                    floor = np.concatenate([b.column(5).to_numpy(zero_copy_only=False) for b in asking])
                    best = _BestK(np.concatenate([_matrix(b.column(4)) for b in asking]), k, metric, floor)
                    points, bound = directed(best.vectors, metric), _distances_of(floor, metric)
                    parts = [slice(at, at + PLACE_ROWS) for at in range(0, len(floor), PLACE_ROWS)]
                    open_ = np.concatenate([open_cells(points[p], bound[p], shared.value[0], high, mine) for p in parts])
                at = int(np.searchsorted(numbers[mine], cell[lo]))
                among = np.nonzero(open_[:, at])[0]
                # Rows seen since may rule the cell out.
                now, here = _distances_of(best.floor[among], metric), slice(mine[at], mine[at] + 1)
                among = among[open_cells(points[among], now, shared.value[0], len(numbers), here)[:, 0]]
                if len(among):
                    for at in range(0, rows.num_rows, SCORE_ROWS):
                        part = rows.slice(at, SCORE_ROWS)
                        best.add(part.column(3), _matrix(part.column(4)), among)
        yield from hits()

    dealt = q.unionByName(x).repartitionById(blocks * slices, F.col("_place").cast("int")).sortWithinPartitions("_place", "_cell")
    return dealt.mapInArrow(run, hit_type)


def cell_search(
    queries: DataFrame,
    cells: Cells,
    k: int = 5,
    probes: int | None = None,
    *,
    first: int = 4,
    query_key: str = "query_id",
    index_key: str = "chunk_key",
    vector: str = "embedding",
    query_block_rows: int = BLOCK_ROWS,
    index_block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The hits of each question, as ``topk`` gives them, and how much was scanned: ``(round, pairs, rows_scored)``.

    Without ``probes`` the search is exact: a round over the ``first`` nearest cells gives each question a distance that its k best
    do not pass, a second one scores all cells that this distance allows. With ``probes`` each question stops after so many cells
    (and is asked again with more only while they hold fewer than k rows), which is approximate. In a round questions are cut into
    blocks and cells are dealt to slices, and every block meets every slice, so a question is copied a few times however many
    cells it probes. ``rows_scored`` counts whole cells; rows found in the same round may rule some of them out.
    """
    spark = queries.sparkSession
    asked = settle(queries.select(query_key, vector), "asked")
    hit_type = _hit_type(asked, cells.rows, query_key, index_key)
    best = spark.createDataFrame([], T.StructType([*hit_type.fields, T.StructField("rank", T.LongType())]))
    order = (cells.numbers, cells.centroids, cells.radii, cells.metric)
    sizes = dict(zip(cells.numbers.tolist(), cells.sizes.tolist()))
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    open_, high, told = asked.withColumn("least", F.lit(float("-inf"))), min(probes or first, len(sizes)), []
    while sizes:
        asks = _asks(open_, order, vector, high)
        told.append((len(told) + 1, float(sum(asks.values())), float(sum(n * sizes[c] for c, n in asks.items()))))
        if asks:
            shape = _grid(open_.count(), sum(sizes[c] for c in asks), cells.centroids.shape[1], query_block_rows, index_block_rows, tasks)
            new = _round(open_, cells, asks, hit_type, k, high, *shape)
            now = open_.select(F.col(query_key).alias("_now")).distinct()
            done = best.drop("rank").join(now, F.col(query_key).eqNullSafe(F.col("_now")), "left_anti")  # the others are found anew
            best = settle(best_hits(done.unionByName(new), k, query_key, index_key), "hits")
        if high >= len(sizes):
            break
        kth = best.filter(F.col("rank") == k).select(query_key, _floor(F.col("score"), cells.metric).alias("kth"))
        open_ = asked.join(kth, query_key, "left").select(query_key, vector, F.coalesce("kth", F.lit(float("-inf"))).alias("least"))
        if probes:
            open_ = open_.filter(F.col("least") == float("-inf"))
        open_ = settle(open_, "open")
        high = min(2 * high, len(sizes)) if probes else len(sizes)
        if not open_.limit(1).count():
            break
    scanned = spark.createDataFrame(told, "round int, pairs double, rows_scored double")
    return rank_hits(best.drop("rank"), k, query_key, index_key), scanned


def _floor(score, metric: str):
    """What is larger for a better row, from the score of a hit."""
    return -score if metric == "l2" else score


def _distances_of(floor: np.ndarray, metric: str) -> np.ndarray:
    """Distance of the points that reach this floor, rounded up a little."""
    return -floor if metric == "l2" else np.sqrt(np.maximum(2 - 2 * floor, 0.0) + SLACK)


def topk_certified(queries: DataFrame, index: DataFrame, k: int = 5, metric: str = "cosine", path: str | None = None, **options) -> DataFrame:
    """Exact k nearest index rows of each question by cells: the rows of ``topk``. Cells are built below ``path`` first."""
    cells = build_cells(index, path or new_folder(index.sparkSession, "cells"), metric)
    return cell_search(queries, cells, k, **options)[0]
