"""Search against brute force, in every physical form, with ties and crowded keys."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docqa.operators import retrieval
from docqa.sources import tables
from docqa.workspace import new_folder

DIM = 16


def vectors(n, seed, copies=0.0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, DIM)).astype(np.float32)
    v[: int(n * copies)] = v[0]
    return v


def frame(spark, v, key):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<float>").repartition(5)


def brute(q, x, k, metric):
    q, x = q.astype(np.float64), x.astype(np.float64)
    if metric == "l2":
        s = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    else:
        s = q @ x.T
        if metric == "cosine":
            s = s / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
    s = np.round(s, 6)
    out = set()
    for i in range(len(q)):
        order = sorted(range(len(x)), key=lambda j: (s[i, j] if metric == "l2" else -s[i, j], j))[:k]
        out |= {(i, j, rank + 1) for rank, j in enumerate(order)}
    return out


def found(df):
    return {(r.query_id, r.chunk_key, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("metric", retrieval.METRICS)
@pytest.mark.parametrize("form", ["scan", "blocks"])
def test_topk_equals_brute_force(spark, metric, form):
    q, x = vectors(37, 1), vectors(450, 2)
    options = {} if form == "scan" else {"max_queries": 3, "query_block_rows": 10, "index_block_rows": 60}
    got = retrieval.topk(frame(spark, q, "query_id"), frame(spark, x, "chunk_key"), 4, metric, **options)
    assert found(got) == brute(q, x, 4, metric)


def ranked_unrounded(q, x, k, metric):
    q, x = q.astype(np.float64), x.astype(np.float64)
    s = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(-1)) if metric == "l2" else -(q @ x.T)
    if metric == "cosine":
        s = s / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
    return {(i, int(j), rank + 1) for i in range(len(q)) for rank, j in enumerate(np.argsort(s[i], kind="stable")[:k])}


@pytest.mark.parametrize("metric", retrieval.METRICS)
@pytest.mark.parametrize("form", ["scan", "blocks"])
def test_ranks_do_not_change_with_the_length_of_all_vectors(spark, metric, form):
    options = {} if form == "scan" else {"max_queries": 3, "query_block_rows": 10, "index_block_rows": 60}
    q, x = vectors(20, 21), vectors(300, 22)
    want = ranked_unrounded(q, x, 5, metric)
    for scale in (1.0, 1e-4):
        q2, x2 = (q * scale).astype(np.float32), (x * scale).astype(np.float32)
        got = found(retrieval.topk(frame(spark, q2, "query_id"), frame(spark, x2, "chunk_key"), 5, metric, **options))
        assert got == want == ranked_unrounded(q2, x2, 5, metric)


@pytest.mark.parametrize("metric", retrieval.METRICS)
def test_crowded_scores_are_ranked_unrounded(spark, metric):
    rng = np.random.default_rng(23)
    q = vectors(5, 24)
    x = (q[0] + 1e-5 * rng.normal(size=(400, DIM))).astype(np.float32)
    got = found(retrieval.topk(frame(spark, q, "query_id"), frame(spark, x, "chunk_key"), 5, metric))
    assert got == ranked_unrounded(q, x, 5, metric)


@pytest.mark.parametrize("form", ["scan", "blocks"])
def test_a_third_of_the_index_and_of_the_questions_are_copies(spark, form):
    q, x = vectors(30, 3, copies=1 / 3), vectors(300, 4, copies=1 / 3)
    q[0] = x[0]
    q[1:10] = x[0]
    options = {} if form == "scan" else {"max_queries": 3, "query_block_rows": 7, "index_block_rows": 31}
    got = retrieval.topk(frame(spark, q, "query_id"), frame(spark, x, "chunk_key"), 6, **options)
    assert found(got) == brute(q, x, 6, "cosine")


def test_small_index_no_questions_and_zero_vectors(spark):
    q, x = vectors(4, 5), vectors(3, 6)
    x[1] = 0
    got = retrieval.topk(frame(spark, q, "query_id"), frame(spark, x, "chunk_key"), 5)
    assert got.count() == 12
    assert {r.score for r in got.filter("chunk_key = 1").collect()} == {0.0}
    none = frame(spark, q, "query_id").filter("query_id < 0")
    assert retrieval.topk(none, frame(spark, x, "chunk_key"), 5).count() == 0


def test_mixed_dimensions_fail(spark):
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "chunk_key bigint, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="dimension"):
        retrieval.topk(asked, bad).collect()


@pytest.mark.parametrize("metric", retrieval.METRICS)
@pytest.mark.parametrize("bad", [float("nan"), None, float("inf")])
def test_vectors_that_are_not_finite_fail(spark, metric, bad):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, bad])], "chunk_key bigint, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="finite"):
        retrieval.topk(asked, rows, 2, metric).collect()


def test_string_keys_break_ties_by_text_order(spark):
    x = spark.createDataFrame([(k, [1.0, 0.0]) for k in ["9:0", "10:0", "10:1", "2:0"]], "chunk_key string, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id bigint, embedding array<float>")
    assert [r.chunk_key for r in retrieval.topk(q, x, 3).orderBy("rank").collect()] == ["10:0", "10:1", "2:0"]


def test_approx_is_whole_and_close_to_exact(spark):
    rng = np.random.default_rng(7)
    x = vectors(600, 8)
    q = (x[:40] + 0.05 * rng.normal(size=(40, DIM))).astype(np.float32)
    asked, rows = frame(spark, q, "query_id"), frame(spark, x, "chunk_key")
    exact = found(retrieval.topk(asked, rows, 1))
    wide = found(retrieval.topk_approx(asked, rows, 1, dim=DIM, planes=4, reach=4))
    assert wide == exact
    near = found(retrieval.topk_approx(asked, rows, 1, dim=DIM, planes=4, reach=1, index_block_rows=25, query_block_rows=9))
    assert len(near) == 40 and len(near & exact) >= 36


@pytest.mark.parametrize("stored", [False, True])
def test_approx_with_a_wanted_recall_finds_it_on_the_embeddings(spark, stored):
    """All 2,000 vectors of sf 0.1 as index and as questions; a vector itself does not count as its neighbour."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.array(v.embedding.tolist())
    asked, rows = frame(spark, x, "query_id"), frame(spark, x, "chunk_key")
    index = tables.build_index(rows, new_folder(spark, "t"), encoder="e", planes=6, dim=64) if stored else rows
    exact = {(q, c) for q, c, _ in brute_many(x, 6) if q != c}
    got = {(q, c) for q, c, _ in found(retrieval.topk_approx(asked, index, 6, dim=64, planes=6, recall=0.9)) if q != c}
    assert len(got & exact) >= 0.9 * len(exact)


def brute_many(x, k):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    best = np.argsort(-(u @ u.T), axis=1, kind="stable")[:, :k]
    return {(i, int(j), rank + 1) for i, row in enumerate(best) for rank, j in enumerate(row)}


def test_approx_widens_until_k_rows_are_in_reach(spark):
    q, x = vectors(12, 9), vectors(20, 10)
    got = retrieval.topk_approx(frame(spark, q, "query_id"), frame(spark, x, "chunk_key"), 15, dim=DIM, planes=5, reach=0)
    assert {r["count"] for r in got.groupBy("query_id").count().collect()} == {15}


def test_approx_with_stored_cells_reads_only_their_folders(spark):
    x = vectors(400, 11, copies=1 / 3)
    rows = frame(spark, x, "chunk_key")
    asked = frame(spark, x[:1], "query_id")
    index = tables.build_index(rows, new_folder(spark, "t"), encoder="e", planes=5, dim=DIM, cell_file_rows=50)
    stored = retrieval.topk_approx(asked, index, 3, dim=DIM, planes=5, reach=0)
    assert found(stored) == found(retrieval.topk_approx(asked, rows, 3, dim=DIM, planes=5, reach=0))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    with pytest.raises(ValueError, match="planes"):
        retrieval.topk_approx(asked, index, 3, dim=DIM, planes=4)


def test_context_count_keeps_questions_without_hits(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    hits = spark.createDataFrame([(1, "a"), (1, "b")], "query_id bigint, chunk_key string")
    assert {tuple(r) for r in retrieval.context_count(asked, hits).collect()} == {(1, 2), (2, 0)}


def test_plan_ranks_with_a_group_limit_and_has_no_cross_join(spark):
    q, x = frame(spark, vectors(5, 12), "query_id"), frame(spark, vectors(50, 13), "chunk_key")
    plan = retrieval.topk(q, x)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    text = x.select("chunk_key", F.lit("t").alias("chunked_text"))
    hits, few = retrieval.search(q, x)
    assert few
    plan = retrieval.attach_text(hits, text, few_hits=few)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("form", ["scan", "blocks"])
def test_proportional_vectors_of_whole_numbers_tie(spark, form):
    """Word counts: rows that are multiples of one another have one cosine, so the smaller key comes first."""
    rng = np.random.default_rng(31)
    base = rng.integers(0, 9, (40, DIM)) + np.eye(DIM, dtype=int)[rng.integers(0, DIM, 40)]
    x = np.concatenate([base * f for f in (7, 3, 1, 5, 11, 13)])[rng.permutation(240)].astype(np.float32)
    q = rng.integers(0, 6, (50, DIM)).astype(np.float32)
    q[0] = 0
    options = {} if form == "scan" else {"max_queries": 3, "query_block_rows": 10, "index_block_rows": 60}
    got = {}
    for r in retrieval.topk(frame(spark, q, "query_id"), frame(spark, x, "chunk_key"), 12, **options).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_key
    from fractions import Fraction

    whole = x.astype(int)
    for i, row in enumerate(q.astype(int)):
        value = [Fraction(int(row @ c) ** 2, int(c @ c)) for c in whole]
        assert [got[i][r] for r in range(1, 13)] == sorted(range(240), key=lambda j: (-value[j], j))[:12]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_neighbouring_ties_by_rounding_go_to_the_smaller_key(spark, metric):
    """The same products summed in another order differ in the last bits only; they tie."""
    rng = np.random.default_rng(32)
    base = rng.normal(size=(60, DIM)).astype(np.float32)
    turns = [rng.permutation(DIM) for _ in range(4)]
    q = np.ones((1, DIM), dtype=np.float32) * np.float32(0.3)
    x = np.concatenate([base[:, t] for t in turns])
    got = retrieval.topk(frame(spark, q, "query_id"), frame(spark, x, "chunk_key"), 240, metric).orderBy("rank").collect()
    place = {r.chunk_key: r["rank"] for r in got}
    wrong = sum(place[i] > place[i + 60 * k] for i in range(60) for k in (1, 2, 3))
    assert wrong == 0


def test_search_beyond_the_bound_copies_rows_a_few_times(spark):
    """Blocks grow with the tables, so neither side is copied once for each small block of the other."""
    for n in (10_000, 100_000, 600_000):
        blocks, slices = retrieval._grid(n, n, 64, 256, 256, 48)
        assert blocks + slices <= 16 and n / blocks * 64 * 8 <= retrieval.BLOCK_BYTES
    rng = np.random.default_rng(5)
    make = lambda name, n: spark.createDataFrame([(i, [float(v) for v in rng.integers(0, 4, 8)]) for i in range(n)], f"{name} long, embedding array<float>").repartition(3)
    asked, rows = make("query_id", 60), make("chunk_key", 300)
    for metric in ("cosine", "dot", "l2"):
        want = sorted(map(tuple, retrieval.topk(asked, rows, 4, metric).collect()))
        assert len(want) == 240
        assert sorted(map(tuple, retrieval.topk(asked, rows, 4, metric, max_queries=0, query_block_rows=7, index_block_rows=11).collect())) == want
    assert retrieval.topk(asked, rows.limit(0), 4, max_queries=0).count() == 0


def test_questions_without_candidates_are_left_out(monkeypatch):
    """A batch that no question's floor lets in is not compared pair by pair; hits are those of all pairs, ties and copies included."""
    rng = np.random.default_rng(71)
    x, q = rng.integers(0, 3, (4000, 12)).astype(float), rng.integers(0, 3, (300, 12)).astype(float)
    x[5] = 0
    for metric in retrieval.METRICS:
        best, compared = retrieval._BestK(q, 4, metric), []
        real = np.flatnonzero
        monkeypatch.setattr(np, "flatnonzero", lambda m: compared.append(m.size) or real(m))
        for lo in range(0, 4000, 500):
            best.add(pa.array(np.arange(lo, lo + 500)), x[lo : lo + 500])
        best.add(pa.array(np.arange(4000, 4500)), np.repeat(x[5:6], 500, axis=0) - (9 if metric == "dot" else 0) + (90 if metric == "l2" else 0))
        monkeypatch.undo()
        best.merge()
        got = {}
        for a, key in zip(best.kept["q"].to_pylist(), best.kept["key"].to_pylist()):
            got.setdefault(a, []).append(key)
        for i in range(len(q)):
            if metric == "l2":
                value = -retrieval.without_noise(((x - q[i]) ** 2).sum(axis=1))
            else:
                s, own = x @ q[i], (x * x).sum(axis=1)
                value = s if metric == "dot" else np.divide(s * np.abs(s), own, out=np.zeros_like(s), where=own > 0)
                value = retrieval.without_noise(value)
            assert got[i] == np.lexsort((np.arange(4000), -value))[:4].tolist()
        assert compared and sum(compared[-2:]) < 300 * 500


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_search_in_blocks_shuffles_no_vector(spark, metric, monkeypatch):
    """Beyond the broadcast bound each block of questions is scanned against the index where it lies: only hits are shuffled, and only
    the chunks that hits name."""
    rng = np.random.default_rng(81)
    make = lambda name, n: spark.createDataFrame([(i if i % 50 else None, [float(v) for v in rng.integers(0, 4, 8)]) for i in range(n)] + [(1, [1.0] * 8)], f"{name} long, embedding array<float>").repartition(3)
    asked, rows = make("query_id", 90), make("chunk_key", 300).filter("chunk_key is not null").dropDuplicates(["chunk_key"])
    want = sorted(map(str, retrieval.topk(asked, rows, 4, metric).collect()))
    plans, real = [], retrieval.settle
    monkeypatch.setattr(retrieval, "settle", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 8 * 8 * 20)
    hits, few = retrieval.search(asked, rows, 4, metric, max_queries=0, query_block_rows=7, index_block_rows=11)
    assert not few and sorted(map(str, hits.collect())) == want
    scans = [p for name, p in plans if name == "hits"]
    assert len(scans) == 5 and all("MapInArrow" in p for p in scans)
    moved = [x for p in scans for x in p.splitlines() if "Exchange" in x and "RoundRobin" not in x]
    assert moved and all("hashpartitioning(query_id" in x for x in moved)
    text = rows.selectExpr("chunk_key", "concat('t', chunk_key) AS chunked_text", "1 AS _asked")
    found = retrieval.attach_text(hits, text)
    assert "LeftSemi, BuildRight" in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieval, "HELD_KEYS", 0)
    whole = retrieval.attach_text(hits, text)
    assert "LeftSemi" not in whole._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect())) and whole.count() > 300
