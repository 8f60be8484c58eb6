"""The corpus pipeline: quality, near-duplicates, secrets, mixing, packing. Each stage is written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docqa.llm import mixing, packing, quality, secrets, simhash
from docqa.llm.common import table
from docqa.workspace import settle


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.deduplicate(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mask."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its Poisson count says, in global random order."""
    return mixing.mix(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in windows."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # a learned model and a tokenizer: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = settle(docs, "stage") if i < len(STAGES) - 1 else docs
    return docs
