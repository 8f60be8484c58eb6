"""Quality classifier by positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docqa.llm.common import column, fresh, table

SAMPLE = 8_000  # rows of either kind that the model is fitted on; everything else covers all rows
HIDDEN = 24
CUT = 0.3
WINDOW = 1024
KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\x0b\x0c", b".,;:'-\"?()", bytes(range(128, 256))]
CLASS = np.full(256, len(KINDS) + 1, dtype=np.uint8)  # other signs
CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = len(KINDS)
for _k, _kind in enumerate(KINDS):
    CLASS[list(_kind)] = _k
N_CLASS = len(KINDS) + 2
WIDTH = 2 * N_CLASS + 8


def features(raw: bytes) -> list[float]:
    """Shares of byte classes over the whole text and their peaks over windows, and how far words and lines repeat."""
    if not raw:
        return [0.0] * WIDTH
    kinds = CLASS[np.frombuffer(raw, dtype=np.uint8)]
    windows = -(-len(kinds) // WINDOW)
    cell = np.arange(len(kinds)) // WINDOW * N_CLASS + kinds
    counts = np.bincount(cell, minlength=windows * N_CLASS).reshape(windows, N_CLASS)
    whole = counts.sum(axis=0) / len(kinds)
    full = counts[:-1] if windows > 1 else counts
    peak = (full / full.sum(axis=1, keepdims=True)).max(axis=0)
    words = raw.lower().split()
    n = max(1, len(words))
    unique = len(set(words)) / n
    runs = sum(map(bytes.__eq__, words, words[1:])) / n
    triples = len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2)
    least = min((len(set(words[i : i + 100])) / 100 for i in range(0, n - 99, 100)), default=unique)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = 1 - len(set(lines)) / max(1, len(lines))
    return [*whole.tolist(), *peak.tolist(), unique, runs, triples, least, same, np.log1p(n), len(raw) / n / 10, np.log1p(len(lines))]


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([features(x.as_py() or b"") for x in batch.column("raw")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made], names=["doc_id", "x"])

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return raw.mapInArrow(run, "doc_id long, x array<double>")


class Net:
    """One hidden layer; ``fit`` minimises prior * P(+) + max(0, U(-) - prior * P(-)) with logistic losses by Adam."""

    def __init__(self, pos, unl, seed: int = 5):
        rng = np.random.default_rng(seed)
        both = np.concatenate([pos, unl])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        width = pos.shape[1]
        self.w = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def z(self, x):
        h = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3][0], h

    def fit(self, pos, unl, prior: float | None, steps: int = 600, rate: float = 0.01, decay: float = 1e-3):
        """Without a prior the positives are told from the unlabelled rows plainly."""
        x = np.concatenate([pos, unl])
        p, u = len(pos), len(unl)
        m, v = [0.0] * 4, [0.0] * 4
        for t in range(1, steps + 1):
            z, h = self.z(x)
            s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            if prior is None:
                g = np.concatenate([(s[:p] - 1) / p, s[p:] / u])
            else:
                loss = np.logaddexp(0, z)
                rest = loss[p:].mean() - prior * loss[:p].mean()
                gu = np.concatenate([-prior * s[:p] / p, s[p:] / u])
                g = np.concatenate([prior * (s[:p] - 1) / p, np.zeros(u)]) + gu if rest >= 0 else -gu
            a = np.outer(g, self.w[2]) * (1 - h**2)
            xs = np.clip((x - self.mean) / self.scale, -6, 6)
            for i, d in enumerate([xs.T @ a + decay * self.w[0], a.sum(axis=0), h.T @ g + decay * self.w[2], np.array([g.sum()])]):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.99 * v[i] + 0.01 * d * d
                self.w[i] = self.w[i] - rate * m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
        return self

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(self.z(x)[0], -40, 40)))


def estimate_prior(pos, unl) -> float:
    """Share of positives among the unlabelled: the density ratio of positives to unlabelled rows is one over the prior where
    all rows are positive, as it is for the greater part of the positives; their median ratio is taken."""
    s = Net(pos, unl).fit(pos, unl, None, steps=300).score(pos)
    return float(np.clip(1 / np.median(s / (1 - s + 1e-9)), 0.05, 0.98))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net | None:
    """Fit on at most ``sample`` trusted positives and ``sample`` unlabelled documents, taken by hash order outside the
    held-out part. Positives are ids whose labels are all 1. None if either kind is missing."""
    order = F.xxhash64("doc_id", F.lit("sample"))
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1 and doc_id is not null").filter(~held_out(F.col("doc_id")))
    good = good.select("doc_id", F.lit(1).alias("kind")).orderBy(order).limit(sample)
    any_ = docs.filter("doc_id is not null").filter(~held_out(F.col("doc_id"))).select("doc_id", F.lit(0).alias("kind")).orderBy(order).limit(sample)
    ids = good.union(any_).groupBy("doc_id").agg(F.max("kind").alias("p"), F.min("kind").alias("u"))
    texts = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")  # at most 2 * sample ids
    rows = _featured(texts).join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id", "x")).limit(2 * sample).toArrow()
    if not rows.num_rows:
        return None
    x, p, u = np.array(rows["x"].to_pylist()), rows["p"].to_numpy() == 1, rows["u"].to_numpy() == 0
    if not p.any() or not u.any():
        return None
    prior = estimate_prior(x[p], x[u])
    net = Net(x[p], x[u]).fit(x[p], x[u], prior)
    net.prior = prior
    return net


def score(docs: DataFrame, net: Net | None, name: str = "quality_score") -> DataFrame:
    """``docs`` with the column ``name``, the net's score of every whole text. A null text scores as an empty one; without a
    net (no positives, or no documents) every score is 0.5. Rows, repeated ones too, and all other columns stay; a
    column ``name`` of the input is replaced; an empty table gives none."""
    docs = docs.drop(name)
    names = [f"c{i}" for i in range(len(docs.columns) + 1)]  # columns go to the task by place, so that any name will do
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features((x.as_py() or "").encode()) for x in batch.column(text)]
            s = net.score(np.array(made).reshape(-1, WIDTH)) if net else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=names)

    kinds = [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)]
    scored = docs.toDF(*names[:-1]).mapInArrow(run, T.StructType([*kinds, T.StructField(names[-1], T.DoubleType())]))
    return scored.toDF(*docs.columns, name)


def accept(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Rows of ``docs`` with a score of at least ``cut``, with the columns of ``docs`` as they are. Null and empty texts are
    scored as empty ones; repeated rows share their verdict; without positive labels all rows stay; an empty table gives none."""
    name = fresh(docs, "score_found")[0]
    return score(docs, train(docs, labels), name).filter(column(name) >= cut).select(*map(column, docs.columns))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
