"""Spelling variants by asymmetric q-chunks: two disjoint chunks of one word against positional grams of the other."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docqa.llm.common import by_unit, in_blocks, table
from docqa.workspace import settle

LEAST, OFTEN, DROP = 5, 3, 97
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST)  # shorter runs can't become words
HOLD = 200_000  # words that a task counts before it hands them on
TILE = 1 << 24  # letters that are compared at once


def occurrences(docs: DataFrame) -> DataFrame:
    """``word, n``: partial counts of the words of every whole text, with the letter taken out of one in ``DROP`` runs.

    Null and empty texts have none; a null doc_id counts as an empty one; repeated rows count as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                low = (text.as_py() or b"").lower().decode()  # bytes: A-Z only
                first = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(RUN.findall(low)).items():
                    h = zlib.crc32(word.encode(), first)
                    if not h % DROP:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < LEAST:
                            continue
                    held[word] += n
                    size += len(word)
                if len(held) > HOLD or size > 100 * HOLD:
                    size = 0
                    yield flush()
        if held:
            yield flush()

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """``word, n`` of the words that occur at least ``often`` times in all documents."""
    return occurrences(docs).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def signatures(words: DataFrame) -> DataFrame:
    """``word, n, key, part, shorter``: the two chunks of each word, and the grams that it holds against chunks of a longer word.

    Of two words the longer one (of equal lengths either) gives the halves of its letters as chunks; one edit preserves one of
    them. In the other word that chunk is a gram of the same length whose place is shifted by no more than one: by as much as the
    word is shorter if it is the second half, else not at all. Grams at places that one edit can't shift a chunk to are left out.
    """
    size = F.length("word")

    def own(longer: int) -> list[Column]:
        whole = size + longer
        half = F.floor(whole / 2).cast("int")
        grams = [F.substr("word", F.lit(1), half), F.substr("word", half + 1 - longer, whole - half)]
        return [F.struct(F.xxhash64(whole, F.lit(part), g).alias("key"), F.lit(part).alias("part"), F.lit(longer).alias("shorter")) for part, g in enumerate(grams)]

    rows = words.select("word", "n", F.explode(F.array(*own(0), *own(1))).alias("s"))
    return rows.select("word", "n", "s.key", "s.part", "s.shorter")


def _letters(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def near_pairs(left: list[bytes], right: list[bytes], part: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of ``left`` (all of one length) and ``right`` (all of that length, or of one less) that differ by
    exactly one edit and share chunk ``part`` as their first."""
    out = []
    size, less = len(left[0]), len(left[0]) - len(right[0])
    half = size // 2
    wide = max(1, TILE // size)
    for b in range(0, len(right), wide):
        y = _letters(right[b : b + wide])[None]
        high = max(1, TILE // (size * y.shape[1]))
        for a in range(0, len(left), high):
            x = _letters(left[a : a + high])[:, None]
            ahead = x[:, :, : size - less] == y
            if less:
                behind = (x[:, :, 1:] == y)[:, :, ::-1]
                reach = [np.where(e.all(axis=2), size - 1, e.argmin(axis=2)) for e in (ahead, behind)]
                near = reach[0] + reach[1] >= size - 1
            else:
                near = (~ahead).sum(axis=2) == 1
            same = ahead[:, :, :half].all(axis=2)
            i, j = np.nonzero(near & (~same if part else same))
            out.append((i + a, j + b))
    return tuple(np.concatenate(p) for p in zip(*out))


def _compare(unit: pa.Table) -> pa.Table:
    """For each word with near words first met here: how many, and the one of largest n (of these the first)."""
    words, (_, low, high) = unit.column("word").to_pylist(), unit.column("unit")[0].as_py()
    n, part, side, shorter, size = (unit.column(c).to_numpy() for c in ("n", "part", "side", "shorter", "size"))
    raw = [w.encode("latin-1") for w in words]
    found = []
    kind = (size + shorter) * 2 + part
    for x in np.unique(kind).tolist():  # one, unless hashes of chunks clash
        own = kind == x

        def rows(of_side: int, is_shorter: int) -> list[int]:
            return np.nonzero(own & (side == of_side) & (shorter == is_shorter))[0].tolist()

        meets = [(rows(low, 0), rows(high, 0)), (rows(low, 0), rows(high, 1))] + ([(rows(high, 0), rows(low, 1))] if low != high else [])
        for k, (a, b) in enumerate(meets):
            if a and b:
                i, j = near_pairs([raw[y] for y in a], [raw[y] for y in b], x % 2)
                i, j = np.array(a)[i], np.array(b)[j]
                found.append((i, j) if k or low != high else (i[i < j], j[i < j]))
    if not found:
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "near_n": pa.array([], pa.int64()), "near": pa.array([], pa.string())})
    i, j = (np.concatenate(p) for p in zip(*found))
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    place = np.argsort(np.argsort(np.array(words, dtype=object), kind="stable"))  # code-point order
    order = np.lexsort((place[j], -n[j], i))
    i, j = i[order], j[order]
    at, first, count = np.unique(i, return_index=True, return_counts=True)
    return pa.table({"word": pa.array([words[x] for x in at], pa.string()), "n_near": count.astype(np.int64), "near_n": n[j[first]], "near": pa.array([words[x] for x in j[first]], pa.string())})


def nearest(words: DataFrame) -> DataFrame:
    """``word, n_near, near_n, near``: words with words at one edit from them, their number, and the most frequent of them.

    A pair is counted at its first shared chunk. Chunks that many words hold are compared in blocks, and every unit gives sums and
    best words, not pairs.
    """
    units = in_blocks(signatures(words).withColumn("size", F.length("word")), "key", F.col("word")).drop("key")
    found = by_unit(units, _compare, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    made = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return made.select("word", "n_near", (-F.col("best.n")).alias("near_n"), "best.near")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form: the end of its chain of forms, by pointer doubling over written rounds.

    A form occurs at least twice as often as its word, so chains are cycle-free and as short as the logarithm of the largest n.
    """
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("via"), F.col("root").alias("end"))
        step = now.join(further, now["root"] == further["via"], "left")
        made = settle(step.select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "roots")
        now = made.select("word", "root")
        if not made.filter("moved").limit(1).count():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row for each word.

    Words are runs of at least ``LEAST`` Latin letters with A-Z lowered that occur ``OFTEN`` times or more. The form is the near
    word (one inserted, deleted or replaced letter) of largest n, of equal ones the smallest, if it occurs at least twice as
    often. Null, empty and very long texts, null ids and repeated rows as in ``occurrences``; an empty table gives none; other
    columns are not read.
    """
    words = settle(vocabulary(docs), "words")
    found = settle(nearest(words), "near")
    known = words.join(found, "word", "left")
    is_form = F.col("near_n") >= 2 * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    ends = roots(known.filter("form is not null"))
    out = known.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


QUERIES = {"op12_spelling": op12_spelling}
