"""Quality rules with thresholds from mergeable quantile sketches for each language and source."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docqa.llm.common import table
from docqa.workspace import settle

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
# Rule: measure, side of the fence, least width of the quartile range that the fence is built from.
RULES = {"symbols": (1, 0.02), "dup_lines": (1, 0.08), "repeats": (1, 0.08), "word_len": (1, 1.0), "word_len_low": (-1, 0.5)}
FENCE = 3.0
BLEND = 50  # rows at which a group's own quartiles count as much as its parent's
ACCURACY = 2000  # of the sketch: rank error at most 1 / ACCURACY


def counts(text: str) -> tuple[int, int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated 3-word windows, lines with a word."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        a = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
        pair = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1]
        _, inverse, times = np.unique(pair[:-1].astype(np.int64) * len(ids) + a[2:], return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        inside = np.zeros(n, dtype=bool)
        for k in range(3):
            inside[k : n - 2 + k] |= again
        repeated = int(inside.sum())
    return n, chars, symbols, sum(c - 1 for c in Counter(lines).values()), repeated, len(lines)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of each whole text; a null text has none of anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [counts(x.as_py() or "") for x in batch.column("text")]
            cols = [pa.array(c, pa.int64()) for c in zip(*made)] if made else [pa.array([], pa.int64())] * len(NAMES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *cols], names=["doc_id", "lang", "source", *NAMES])

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in NAMES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(run, schema)


def _blended(own: str, parent: str, n: str) -> dict:
    """Quartiles of a group for each rule: its own blended with its parent's by row count, or the parent's where the quartile on
    the rule's side lies beyond the parent's fence."""
    out = {}
    for k, (side, least) in RULES.items():
        low, high = F.col(f"{parent}{k}")[0], F.col(f"{parent}{k}")[1]
        width = FENCE * F.greatest(high - low, F.lit(least))
        far = (F.col(f"{own}{k}")[1] > high + width) if side > 0 else (F.col(f"{own}{k}")[0] < low - width)
        share = F.col(n) / (F.col(n) + BLEND)
        mix = F.transform(F.arrays_zip(F.col(f"{own}{k}").alias("own"), F.col(f"{parent}{k}").alias("parent")), lambda x: share * x["own"] + (1 - share) * x["parent"])
        out[f"{own}{k}"] = F.when(far, F.col(f"{parent}{k}")).otherwise(mix)
    return out


def limits(rows: DataFrame) -> DataFrame:
    """``__lang, __source`` and the quartiles ``__q_`` of each rule's measure: source within language, blended with the
    language's, and these with those of all rows."""

    def of(name: str, *by: Column) -> DataFrame:
        return rows.groupBy(*by).agg(F.count("*").alias(f"__n{name}"), *[F.percentile_approx(f"__{k}", [0.25, 0.75], ACCURACY).alias(f"{name}{k}") for k in RULES])

    whole = of("__all_")
    langs = of("__lang_", F.col("lang").alias("__of")).crossJoin(F.broadcast(whole))
    langs = langs.withColumns(_blended("__lang_", "__all_", "__n__lang_")).select("__of", *[f"__lang_{k}" for k in RULES])
    own = of("__q_", F.col("lang").alias("__lang"), F.col("source").alias("__source"))
    own = own.join(langs, F.col("__lang").eqNullSafe(F.col("__of"))).withColumns(_blended("__q_", "__lang_", "__n__q_"))
    return own.select("__lang", "__source", *[f"__q_{k}" for k in RULES])


def judge(docs: DataFrame, fence: float = FENCE) -> DataFrame:
    """The counts with ``base_failed`` and ``kept``.

    A document that passes the base rules is kept if none of its measures lies beyond the quartiles of its language and source
    by more than ``fence`` quartile ranges. The quartiles come from percentile sketches, which merge partial sketches of all
    tasks; a small group or one far outside its parent (``limits``) is held against its language's, and so on to all rows. Null languages and sources are groups of their own; repeated rows count as often as they occur; a text without words
    fails the base; an empty table gives none.
    """
    rows = settle(measured(docs), "measured")
    words = F.greatest(F.col("n_words"), F.lit(1))
    share = {
        "symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "word_len": F.col("word_chars") / words,
        "word_len_low": F.col("word_chars") / words,
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, **{f"__{k}": v for k, v in share.items()}})
    near = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    beyond = F.lit(False)
    for k, (side, least) in RULES.items():
        low, high = F.col(f"__q_{k}")[0], F.col(f"__q_{k}")[1]
        width = fence * F.greatest(high - low, F.lit(least))
        beyond = beyond | F.coalesce((F.col(f"__{k}") > high + width) if side > 0 else (F.col(f"__{k}") < low - width), F.lit(False))
    joined = rows.join(limits(rows.filter("not base_failed")), near, "left").withColumn("kept", ~F.col("base_failed") & ~beyond)
    return joined.select("doc_id", "lang", "source", *NAMES, "base_failed", "kept")


def op5_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *NAMES[:5], "base_failed", "kept")


QUERIES = {"op5_rules": op5_rules}
