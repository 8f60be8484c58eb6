"""Selecting source files, assembling documents from pages, reading evaluation examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docqa.functions.text import has_suffix, is_blank

EXAMPLE_TYPE = T.StructType(
    [
        T.StructField("inputs", T.StructType([T.StructField("question", T.StringType())])),
        T.StructField("expectations", T.StructType([T.StructField("expected_facts", T.ArrayType(T.StringType()))])),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and sizes below a folder; the file contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    )


def select_files(df: DataFrame, path_col: str, suffix: str) -> DataFrame:
    """All rows whose path ends in the suffix, in any case."""
    return df.filter(has_suffix(F.col(path_col), suffix))


def first_file(df: DataFrame, path_col: str, suffix: str) -> str:
    """Smallest matching path; raises if there is none."""
    path = select_files(df, path_col, suffix).agg(F.min(path_col)).first()[0]
    if path is None:
        raise FileNotFoundError(f"no {suffix} file found")
    return path


def valid_path_flag(c: Column, suffix: str) -> Column:
    return F.coalesce(has_suffix(c, suffix), F.lit(False))


def split_valid_paths(df: DataFrame, path_col: str, suffix: str) -> tuple[DataFrame, DataFrame]:
    """Rows with an acceptable path, and the rejected rest."""
    ok = valid_path_flag(F.col(path_col), suffix)
    return df.filter(ok), df.filter(~ok)


def spread(df: DataFrame) -> DataFrame:
    """Spread an input too small for the scan to fill all cores; a large input stays as it was read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    smallest_split = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * smallest_split else df


def assemble_document(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """One row per document: its non-blank pages joined by newlines in page order, and counts.

    ``page_count`` includes blank pages, the text does not. The order is carried inside the aggregate, so
    one shuffle by document does all of it.
    """
    kept = F.when(~is_blank(F.col(text)), F.struct(F.col(page).alias("page"), F.col(text).alias("text")))
    return (
        pages.groupBy(doc)
        .agg(F.array_sort(F.collect_list(kept)).alias("kept"), F.count("*").alias("page_count"))
        .select(
            doc,
            F.array_join(F.col("kept")["text"], "\n").alias("text"),
            F.col("page_count").cast("bigint").alias("page_count"),
        )
    )


def document_stats(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """Characters of the joined text and number of pages per document, without building the text."""
    kept = ~is_blank(F.col(text))
    chars = F.sum(F.when(kept, F.char_length(text) + 1).otherwise(0))
    return pages.groupBy(doc).agg(
        F.greatest(chars - 1, F.lit(0)).cast("bigint").alias("char_count"),
        F.count("*").cast("bigint").alias("page_count"),
    )


def eval_examples(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A hand-written evaluation set."""
    return spark.createDataFrame(rows, EXAMPLE_TYPE)


def read_examples(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """An evaluation set kept as files with the same layout."""
    return spark.read.format(fmt).schema(EXAMPLE_TYPE).load(path)
