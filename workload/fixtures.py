"""Inputs derived from the given tables; ``oracles.py`` derives the same ones in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docqa.operators.chat import last_user_message
from docqa.operators.chunking import chunk_documents
from docqa.operators.embedding import HashEncoder
from docqa.sources.reading import spread

ENCODER = HashEncoder(256)
K = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files: a pattern that only its name matches may be either."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as titled or untitled sections, some ending in a heading without a body."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    heading = F.when(F.col("doc_id") % 3 == 0, "").otherwise(
        F.concat(F.lit("第"), F.col("doc_id"), F.lit("条（"), F.col("source"), F.lit("）\n"))
    )
    ending = F.when(F.col("doc_id") % 5 == 0, "\n \n第99条 末尾").otherwise("")
    return docs.select(
        "doc_id",
        F.concat("source", F.lit(".pdf")).alias("file_name"),
        F.concat(heading, F.replace("text", F.lit("\n"), F.lit("\n \n")), ending).alias("text"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(sectioned(spark, sf_dir), file_name="file_name")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = last_user_message(conversations(spark, sf_dir))
    return asked.select(F.col("conv_id").alias("query_id"), "question")


def chat_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and each once more without a user message."""
    return with_gaps(conversations(spark, sf_dir))


def with_gaps(messages: DataFrame) -> DataFrame:
    """All messages, and each again under a negative conv_id with the system's role in place of the user's; also for streams."""
    other = F.when(F.col("role") == "user", "system").otherwise(F.col("role"))
    both = F.array(F.struct("conv_id", "role"), F.struct((-1 - F.col("conv_id")).alias("conv_id"), other.alias("role")))
    rest = [c for c in messages.columns if c not in ("conv_id", "role")]
    return messages.select(F.explode(both).alias("as"), *rest).select("as.conv_id", *rest[:1], "as.role", *rest[1:])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: a message is a page, every third page is blank."""
    return conversations(spark, sf_dir).select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("page_no"),
        F.when(F.col("turn") % 3 == 2, " \n").otherwise(F.col("text")).alias("text"),
    )


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sectioned documents cut into pages of 40 lines each, so that sections and blank lines fall on page ends."""
    lines = sectioned(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.groupBy("doc_id", F.floor(F.col("n") / 40).alias("page_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text")
    )


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents: French ones arrive, Spanish ones go, one source is edited."""
    docs = table(spark, sf_dir, "documents")
    edited = F.when(F.col("source") == "src7", F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    old = docs.filter(F.col("lang") != "fr").select("doc_id", "text")
    new = docs.filter(F.col("lang") != "es").select("doc_id", edited.alias("text"))
    return old, new


def vector_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the vectors: label 0 arrives, label 1 goes, label 2 is doubled."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_key")
    doubled = F.when(
        F.col("label") == 2, F.transform("embedding", lambda x: (x * 2).cast("float"))
    ).otherwise(F.col("embedding"))
    old = rows.filter(F.col("label") != 0).select("chunk_key", "embedding")
    new = rows.filter(F.col("label") != 1).select("chunk_key", doubled.alias("embedding"))
    return old, new


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation example per conversation: its open question, two facts and two tags."""
    msgs = conversations(spark, sf_dir)
    is_reply = F.col("role") == "assistant"
    rows = msgs.groupBy("conv_id").agg(
        F.coalesce(
            F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))),
            F.lit(""),
        ).alias("question"),
        F.max_by(F.when(is_reply, F.col("text")), F.when(is_reply, F.col("turn"))).alias("reply"),
    )

    def first_words(c: str, n: int):
        return F.array_join(F.slice(F.split(c, " "), 1, n), " ")

    level = F.when(F.col("conv_id") % 3 == 0, "easy").when(F.col("conv_id") % 3 == 1, "medium").otherwise("hard")
    return rows.select(
        "conv_id",
        F.struct("question").alias("inputs"),
        F.struct(
            F.array(F.coalesce(first_words("reply", 5), F.lit("no reply")), F.element_at(F.split("question", " "), -1)).alias("expected_facts")
        ).alias("expectations"),
        F.create_map(
            F.lit("category"), F.concat(F.lit("c"), F.col("conv_id") % 5), F.lit("difficulty"), level
        ).alias("tags"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last assistant message as the answer and the first message as its context; none without a reply."""
    is_reply = F.col("role") == "assistant"
    return (
        conversations(spark, sf_dir)
        .groupBy("conv_id")
        .agg(
            F.max_by(F.when(is_reply, F.col("text")), F.when(is_reply, F.col("turn"))).alias("answer"),
            F.min_by("text", "turn").alias("context_text"),
        )
        .filter(F.col("answer").isNotNull())
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Japanese rules with their own text after them: ``(chunk_key, chunked_text)``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text"))
    own, other = topic(F.col("doc_id")), topic(F.col("doc_id") * 7 + 3)
    parts = ["第", F.col("doc_id"), "条（", own, "）:\n", own, "は月額", F.col("n_chars"), "円とし、", F.col("source"), "が支給する。", other, "については別に定める。", F.col("text")]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_key"), text.alias("chunked_text"))


def rule_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Japanese question about two topics for each conversation."""
    asked = conversations(spark, sf_dir).select("conv_id").distinct()
    conv = F.col("conv_id")
    parts = [topic(conv), "はいくらですか。", conv % 7, "条の", topic(conv * 5 + 1), "も教えてください。"]
    question = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return asked.select(conv.alias("query_id"), question.alias("question"))


def topic(n):
    from workload.oracles import TOPICS

    return F.element_at(F.array(*map(F.lit, TOPICS)), (n % len(TOPICS) + 1).cast("int"))
