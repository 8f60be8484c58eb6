"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docqa.llm.common import table
from docqa.llm.packing import Coder, vocabulary
from docqa.workspace import settle


def lengths(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every whole text; a null or empty text has none."""
    path = vocabulary_path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            n = [len(coder.encode(x.as_py())) // 4 if x.as_py() else 0 for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(docs: DataFrame) -> DataFrame:
    """``n_tokens, n_docs``: repeated rows count as often as they occur; an empty table gives none."""
    return lengths(docs).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def by_limit(hist: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: documents up to it and over it, their share (so quantiles),
    all tokens, and the tokens left when every document is cut there.

    Suffix sums run over the histogram, whose rows are bounded by the longest text, not by the number of documents. Between
    two lengths the truncated total grows by ``n_over`` a token, so the rows answer every limit.
    """
    hist = settle(hist, "histogram")
    over = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    sums = hist.select("n_tokens", "n_docs", F.coalesce(F.sum("n_docs").over(over), F.lit(0)).alias("n_over"), F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(over), F.lit(0)).alias("over_tokens"))
    total = hist.agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("total_tokens"))
    rows = sums.join(F.broadcast(total), F.lit(True))  # one row
    return rows.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", (F.col("docs") - F.col("n_over")).alias("n_within"), "n_over",
        ((F.col("docs") - F.col("n_over")) / F.col("docs")).alias("quantile"), "total_tokens",
        (F.col("total_tokens") - F.col("over_tokens") + F.col("n_over") * F.col("n_tokens")).alias("truncated_tokens"),
    )


def op9_tokens(spark, sf_dir: str) -> DataFrame:
    return by_limit(histogram(table(spark, sf_dir, "documents")))


QUERIES = {"op9_tokens": op9_tokens}
