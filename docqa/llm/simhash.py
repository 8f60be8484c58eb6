"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docqa.llm.common import by_unit, column, components, fresh, in_blocks, local_roots, spread, table
from docqa.workspace import settle

MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011  # fixed value: generator polynomial of the perfect binary Golay code (23, 12)
RADIUS = 3
SLICE = 1 << 15


def fingerprint(raw: bytes) -> int:
    """64-bit majority of the XXH64 values of the text's 4-word shingles; no word gives zero."""
    import numpy as np
    import xxhash

    words = raw.lower().split()  # bytes: lowers A-Z only and splits at 0x20 and 0x09-0x0D only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - 3)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLICE):
        part = words[at : at + SLICE + 3]
        buf, size = b" ".join(part), np.fromiter(map(len, part), np.int64, len(part)) + 1
        ends = np.cumsum(size)
        first = ends - size
        here = min(SLICE, n - at)
        stop = ends[np.minimum(np.arange(here) + 3, len(part) - 1)] - 1
        h = np.array([digest(buf[s:e], 42) for s, e in zip(first[:here].tolist(), stop.tolist())], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in (2 * ones > n).nonzero()[0].tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, __fp, __text``: the fingerprint of every whole text as a signed long, and a hash of the text; a null text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x.as_py() or b"") for x in batch.column("__raw")]
            fps = pa.array([x - (1 << 64) if x >> 63 else x for x in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps, batch.column("__text")], names=["doc_id", "__fp", "__text"])

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("__raw"), F.xxhash64("text").alias("__text"))
    return raw.mapInArrow(run, "doc_id long, __fp long, __text long")


def _remainder(x):
    """Remainders of 23-bit words modulo the generator polynomial."""
    for bit in range(22, 10, -1):
        x = x ^ (((x >> bit) & 1) * (GENERATOR << (bit - 11)))
    return x


def _offsets(radius: int):
    """For each of the 2,048 cosets, the error patterns of at most ``radius`` bits in it."""
    from itertools import combinations

    import numpy as np

    errors = np.array([sum(1 << b for b in c) for w in range(radius + 1) for c in combinations(range(23), w)], dtype=np.int64)
    coset = _remainder(errors.copy())
    order = np.argsort(coset, kind="stable")
    counts = np.bincount(coset, minlength=2048)
    return errors[order], np.cumsum(counts) - counts, counts


def anchors(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``__fp, anchor``: each fingerprint with every anchor within covering radius plus threshold, in each segment.

    The anchors of a segment are the Golay code words. Every word lies within three bits of one. Of two fingerprints at most
    ``bits`` apart, one of the three segments differs by at most bits // 3, so both lie within 3 + bits // 3 of one anchor.
    """
    radius = RADIUS + bits // len(SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        errors, first, counts = _offsets(radius)
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for s, (low, width) in enumerate(SEGMENTS):
                word = (fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
                coset = _remainder(word.copy())
                n = counts[coset]
                row = np.repeat(np.arange(len(fp)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[coset][row]
                anchor = (word[row] ^ errors[at]) | (s << 32)
                yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(anchor)], names=["__fp", "anchor"])

    return fps.mapInArrow(run, "__fp long, anchor long")


def near_links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links ``u, v`` that join all distinct fingerprints at most ``bits`` apart: a spanning forest for each unit."""

    def work(unit: pa.Table) -> pa.Table:
        import numpy as np

        x = np.sort(unit.column("__fp").to_numpy())
        a, b = [], []
        for at in range(0, len(x), 256):
            d = np.bitwise_count(x[at : at + 256, None].view(np.uint64) ^ x[None, at:].view(np.uint64)) <= bits
            i, j = np.nonzero(d)
            keep = j > i
            a.append(i[keep] + at)
            b.append(j[keep] + at)
        root = local_roots(len(x), np.concatenate(a), np.concatenate(b))
        moved = root != np.arange(len(x))
        return pa.table({"u": x[moved], "v": x[root[moved]]})

    return by_unit(in_blocks(anchors(fps, bits), "anchor", F.col("__fp")), work, "u long, v long")


def _classed(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The written fingerprints of all rows, and each distinct one with its component's root and smallest doc_id."""
    made = settle(fingerprints(docs), "fingerprints")
    nodes = settle(made.groupBy("__fp").agg(F.min("doc_id").alias("__first")), "nodes")
    found = components(near_links(spread(nodes.select("__fp")), bits))
    known = nodes.join(found, nodes["__fp"] == found["node"], "left").select("__fp", "__first", F.coalesce("root", "__fp").alias("__root"))
    first = known.groupBy("__root").agg(F.min("__first").alias("component_id"))
    return made, known.join(first, "__root").select("__fp", "__root", "component_id")


def classes(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Equal fingerprints are one node before anything is compared, so copies cost one row. Null texts and texts without
    words have fingerprint zero; repeated rows keep their rows; a null doc_id stays and never is a component's id unless
    alone; an empty table gives none. Other columns are not read.
    """
    made, ids = _classed(docs, bits)
    return made.join(ids, "__fp").select("doc_id", F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: that of the smallest doc_id, null ids last, of one id that of the smallest text hash.

    Rows are told apart by doc_id and text, so unlike texts of one doc_id are judged each by itself, and of rows equal in both one
    stays, whatever else they hold. Null and empty texts are one component; an empty table gives none; all columns stay.
    """
    made, ids = _classed(docs, bits)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__text")
    stay = made.join(ids.select("__fp", "__root"), "__fp").groupBy("__root").agg(F.min(place).alias("x"))
    key, own, own_text = fresh(docs, "text_key", "stays", "stays_text")
    stay = stay.select(F.col("x.doc_id").alias(own), F.col("x.__text").alias(own_text))
    rows = docs.withColumn(key, F.xxhash64("text"))
    left = rows.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(key) == F.col(own_text)), "left_semi")
    return left.dropDuplicates(["doc_id", key]).select(*map(column, docs.columns))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash": op3_simhash}
