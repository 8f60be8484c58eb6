"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docqa.functions.text import (
    base_name,
    normalize_newlines,
    section_content,
    section_title,
    split_sections,
    truncate_text,
)
from docqa.functions.vectors import as_float_array
from docqa.operators import answering, chat, chunking, evaluation, retrieval, runlog
from docqa.operators.cells import topk_certified as topk_cells
from docqa.operators.changes import change_feed as feed_between
from docqa.operators.embedding import BatchEncoder, embed, tfidf_embed as tfidf
from docqa.operators.postings import topk_lists as search_lists
from docqa.plans.answer import answer, answer_conversations, retrieve
from docqa.plans.evaluate import evaluate_engine, score_all
from docqa.plans.index import chunk_table, empty_index, index_documents, synced_index
from docqa.sources import reading, tables
from docqa.streaming import jobs
from docqa.workspace import new_folder, settle
from workload import fixtures as fx

K = fx.K


# Sources

def file_select(spark: SparkSession, sf: str) -> DataFrame:
    return reading.select_files(fx.table(spark, sf, "pages"), "url", ".HTML").select("page_id", "url")


def path_validate(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "pages").select(
        "page_id", reading.valid_path_flag(F.col("url"), ".html").alias("is_valid")
    )


def file_base_name(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "pages").select("page_id", base_name(F.col("url")).alias("base_name"))


def assemble_document(spark: SparkSession, sf: str) -> DataFrame:
    return reading.assemble_document(fx.pages(spark, sf))


def document_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reading.document_stats(fx.pages(spark, sf))


def eval_examples(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "examples")
    fx.examples(spark, sf).select("inputs", "expectations", "tags").write.json(folder)
    return reading.read_examples(spark, folder).select(
        F.col("inputs.question").alias("question"),
        F.array_join("expectations.expected_facts", "|").alias("facts"),
        F.col("tags")["category"].alias("category"),
        F.col("tags")["difficulty"].alias("difficulty"),
    )


# Text

def normalized(spark: SparkSession, sf: str) -> DataFrame:
    docs = reading.spread(fx.table(spark, sf, "documents").select("doc_id", "text"))
    doubled = F.concat(F.lit("\n　"), F.replace("text", F.lit("\n"), F.lit("\n\n\n")), F.lit(" \n"))
    return docs.select("doc_id", normalize_newlines(doubled).alias("text"))


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sectioned(spark, sf).select(
        "doc_id", F.posexplode(split_sections(normalize_newlines(F.col("text")))).alias("pos", "section")
    )


def sections(spark: SparkSession, sf: str) -> DataFrame:
    return _sections(spark, sf).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "section")


def section_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _sections(spark, sf).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), section_title(F.col("section")).alias("title")
    )


def section_contents(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _sections(spark, sf)
        .withColumn("title", section_title(F.col("section")))
        .select(
            "doc_id",
            F.col("pos").cast("bigint").alias("pos"),
            section_content(F.col("section"), F.col("title")).alias("content"),
        )
    )


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return fx.chunks(spark, sf)


def chunk_count(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_count(fx.sectioned(spark, sf))


def cast_embedding(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("wide"))
    return rows.select("vec_id", F.posexplode(as_float_array(F.col("wide"))).alias("i", "value")).select(
        "vec_id", F.col("i").cast("bigint").alias("i"), "value"
    )


def truncate_answer(spark: SparkSession, sf: str) -> DataFrame:
    return fx.conversations(spark, sf).select("conv_id", "turn", truncate_text(F.col("text"), 300).alias("short"))


# Embedding

def _nonzero(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    return (
        df.select(key, F.posexplode_outer(vector).alias("bucket", "value"))
        .filter(F.col("value") != 0)
        .select(key, F.col("bucket").cast("bigint").alias("bucket"), F.col("value").cast("double").alias("value"))
    )


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    docs = reading.spread(fx.table(spark, sf, "documents").select("doc_id", "text"))
    return _nonzero(embed(docs, "text", fx.ENCODER), "doc_id")


def japanese_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Japanese rules with Latin text after them, as hashed words."""
    return _nonzero(embed(fx.rules(spark, sf), "chunked_text", fx.ENCODER), "chunk_key")


def _letter_profile():
    """A stand-in model: counts of the letters a-z."""
    import numpy as np

    def encode(texts):
        out = np.zeros((len(texts), 26), dtype=np.float32)
        for i, text in enumerate(texts):
            codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            codes = codes[(codes >= 97) & (codes <= 122)] - 97
            out[i] = np.bincount(codes, minlength=26)
        return out

    return encode


def embed_udf(spark: SparkSession, sf: str) -> DataFrame:
    docs = reading.spread(fx.table(spark, sf, "documents").select("doc_id", "text"))
    return _nonzero(embed(docs, "text", BatchEncoder("letters", 26, _letter_profile)), "doc_id")


def tfidf_embed(spark: SparkSession, sf: str) -> DataFrame:
    docs = reading.spread(fx.table(spark, sf, "documents").select("doc_id", "text"))
    return _nonzero(tfidf(docs, "text", fx.ENCODER.dim), "doc_id").withColumn("value", F.round("value", 4))


# Retrieval

def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = fx.table(spark, sf, "embeddings")
    return (
        rows.select(F.col("vec_id").alias("query_id"), "embedding"),
        rows.select(F.col("vec_id").alias("chunk_key"), "embedding"),
    )


def topk_dense(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.topk(*_vectors(spark, sf), K, "cosine")


def topk_dot(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.topk(*_vectors(spark, sf), K, "dot")


def topk_l2(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.topk(*_vectors(spark, sf), K, "l2")


def topk_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The form for question sets beyond the broadcast bound."""
    return retrieval.topk(
        *_vectors(spark, sf), K, "cosine", max_queries=0, query_block_rows=256, index_block_rows=256
    )


def topk_certified(spark: SparkSession, sf: str) -> DataFrame:
    """Cells probed in order of distance until each question's k best are proved."""
    asked, rows = _vectors(spark, sf)
    return topk_cells(asked, rows, K)


def topk_lsh(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate search in an index that is laid out by cells."""
    asked, rows = _vectors(spark, sf)
    index = tables.build_index(rows, new_folder(spark, "cells"), encoder="given", planes=6, dim=64)
    return retrieval.topk_approx(asked, index, K, "cosine", dim=64, planes=6)


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return embed(fx.chunks(spark, sf), "chunked_text", fx.ENCODER)


def topk_sparse(spark: SparkSession, sf: str) -> DataFrame:
    asked = embed(fx.questions(spark, sf), "question", fx.ENCODER)
    return retrieval.topk(asked, _index(spark, sf), K, "cosine")


def topk_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The same search by inverted lists with score bounds."""
    asked = embed(fx.questions(spark, sf), "question", fx.ENCODER).filter(F.col("question") != "")
    return search_lists(asked, _index(spark, sf), K)


def _corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Index and chunks, cut once: the search reads the vectors, the fetch of the hits the texts."""
    chunks = settle(fx.chunks(spark, sf), "chunks")
    return embed(chunks, "chunked_text", fx.ENCODER), chunks


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve(fx.questions(spark, sf), *_corpus(spark, sf), fx.ENCODER, K)


def retrieve_with_text(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("query_id", "chunk_key", "score", "rank", "chunked_text")


def context_count(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of conversations with gaps: those without a question have no context."""
    asked = chat.last_user_message(fx.chat_with_gaps(spark, sf)).withColumnRenamed("conv_id", "query_id")
    hits = retrieve(asked, *_corpus(spark, sf), fx.ENCODER, K)
    return retrieval.context_count(asked, hits)


# Answering

def stuff_context(spark: SparkSession, sf: str) -> DataFrame:
    return answering.stuff_context(_hits(spark, sf))


def _answered(spark: SparkSession, sf: str, **options) -> DataFrame:
    return answer(fx.questions(spark, sf), *_corpus(spark, sf), fx.ENCODER, K, **options)


def render_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _answered(spark, sf).select("query_id", "prompt")


def extractive_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _answered(spark, sf).select("query_id", "answer")


def answer_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: every conversation's open question, answered from the documents."""
    return answer_conversations(fx.conversations(spark, sf), *_corpus(spark, sf), fx.ENCODER, k=K).select(
        "conv_id",
        "question",
        F.size("context").cast("bigint").alias("context_documents"),
        F.col("context")[0]["chunk_key"].alias("best_chunk"),
        F.col("context")[0]["score"].alias("best_score"),
        F.char_length("prompt").cast("bigint").alias("prompt_chars"),
        "answer",
    )


def japanese_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Japanese questions answered from Japanese rules, with the relevance and the grounding of the answers."""
    chunks = settle(fx.rules(spark, sf), "rules")
    index = embed(chunks, "chunked_text", fx.ENCODER)
    rows = answer(fx.rule_questions(spark, sf), index, chunks, fx.ENCODER, K).withColumn("context_text", answering.context_text(F.col("context")))
    scored = evaluation.score_grounding(evaluation.score_relevance(rows, "question"))
    return scored.select(
        "query_id", "question", F.col("context")[0]["chunk_key"].alias("best_chunk"), F.col("context")[0]["score"].alias("best_score"),
        "answer", F.col("`relevance_evaluator/value`").alias("relevance"), "grounding_share",
    )


def _last_line_model():
    """A stand-in model: answers with the last line of the prompt."""
    return lambda prompts: [p.rsplit("\n", 1)[-1] for p in prompts]


def generate_hook(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.conversations(spark, sf).select(
        "conv_id",
        "turn",
        F.col("text").alias("question"),
        answering.render_prompt(F.col("role"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("prompt"),
    )
    return answering.generate(rows, _last_line_model).select("conv_id", "turn", "answer")


def _shy_model():
    """A stand-in model that fails on some prompts and has no answer for others."""

    def one(prompt: str):
        if len(prompt) % 5 == 0:
            raise ValueError(f"{len(prompt)} characters")
        return None if len(prompt) % 5 == 1 else str(len(prompt))

    return lambda prompts: [one(p) for p in prompts]


def guarded_predict(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.conversations(spark, sf).select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "system", "").otherwise(F.col("text")).alias("question"),
        F.col("text").alias("prompt"),
    )
    return answering.generate(rows, _shy_model).select("conv_id", "turn", "answer", "error")


# Conversations

def last_user_message(spark: SparkSession, sf: str) -> DataFrame:
    return chat.last_user_message(fx.chat_with_gaps(spark, sf))


def _short_replies(spark: SparkSession, sf: str) -> DataFrame:
    opened = chat.last_user_message(fx.chat_with_gaps(spark, sf))
    return opened.withColumn("answer", F.concat(F.lit("re: "), "question"))


def chat_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _short_replies(spark, sf).select(
        "conv_id", chat.with_fallback(F.col("answer"), F.col("question")).alias("content")
    )


def chat_reply(spark: SparkSession, sf: str) -> DataFrame:
    return chat.reply_rows(_short_replies(spark, sf)).select("conv_id", "reply.*")


def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every message cut into pieces; the system's messages count as a missing question."""
    text = F.replace("text", F.lit("."), F.lit("。"))
    present = F.col("role") != "system"
    rows = fx.conversations(spark, sf).select(
        "conv_id",
        F.col("turn").alias("last_turn"),
        F.when(present, text).otherwise("").alias("question"),
        text.alias("answer"),
    )
    return chat.stream_rows(rows).select("conv_id", "message_id", F.col("pos").cast("bigint").alias("pos"), "content")


# Evaluation

def _paired(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.run_evaluation(fx.examples(spark, sf), fx.predictions(spark, sf), "conv_id")


def run_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return _paired(spark, sf).select("conv_id", F.col("inputs.question").alias("question"), "answer", "context_text")


def score_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.score_accuracy(_paired(spark, sf)).select(
        "conv_id", "accuracy_share", F.col("`accuracy_evaluator/value`").cast("bigint").alias("accuracy")
    )


def score_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.score_relevance(_paired(spark, sf)).select(
        "conv_id", F.col("`relevance_evaluator/value`").alias("relevance")
    )


def score_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Every assistant message against the message before it, found by an even join on conversation and turn."""
    messages = fx.conversations(spark, sf)
    before = messages.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context_text"))
    replies = messages.filter(F.col("role") == "assistant").select("conv_id", "turn", "text")
    return evaluation.score_grounding(replies.join(before, ["conv_id", "turn"], "left"), "text").select(
        "conv_id", "turn", "grounding_share", F.col("`grounding_evaluator/value`").alias("grounding")
    )


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """Every assistant message with all earlier messages of its conversation as its context."""
    messages = fx.conversations(spark, sf)
    earlier = messages.select("conv_id", F.col("turn").alias("at"), "text").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("all"))
    before = F.array_join(F.transform(F.filter("all", lambda x: x["at"] < F.col("turn")), lambda x: x["text"]), "\n")
    replies = messages.filter(F.col("role") == "assistant").join(earlier, "conv_id")
    # Each reply also cites the start of its context, so that runs of every length occur.
    cited = F.concat("answer", F.lit(" "), F.substring_index("context_text", " ", 12), F.lit("."))
    return replies.select("conv_id", "turn", F.col("text").alias("answer"), before.alias("context_text")).withColumn("answer", cited)


def align_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Each sentence of the replies with the longest run of its words in the conversation before."""
    return evaluation.align_answers(_replies(spark, sf), ["conv_id", "turn"])


def score_alignment(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.score_alignment(_replies(spark, sf), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.round("covered_share", 6).alias("covered_share"), F.col("`alignment_evaluator/value`").alias("alignment"))


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.metrics(score_all(_paired(spark, sf)))


def metrics_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.metrics_by_tag(score_all(_paired(spark, sf)), ["category", "difficulty"])
    return rows.select(
        "category",
        "difficulty",
        "examples",
        F.col("`accuracy_share/mean`").alias("accuracy_share"),
        F.col("`relevance_evaluator/mean`").alias("relevance"),
        F.col("`grounding_share/mean`").alias("grounding_share"),
    )


def evaluate_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The engine's own answers to the examples: answered, scored, saved and logged."""
    chunks = settle(fx.chunks(spark, sf), "chunks")
    index = embed(chunks, "chunked_text", fx.ENCODER)
    folders = [new_folder(spark, name) for name in ("engine_results", "engine_runs")]
    saved = evaluate_engine(fx.examples(spark, sf), "conv_id", index, chunks, fx.ENCODER, "engine", "docqa_engine_results", *folders, k=K)
    scores = saved.select("conv_id", "answer", "accuracy_share", F.col("`relevance_evaluator/value`").alias("relevance"), "grounding_share", F.col("`grounding_evaluator/value`").alias("grounding"))
    means = runlog.read_log(spark, folders[1]).filter("key like '%/mean'").select("key", F.round(F.col("value").cast("double"), 6).alias("mean"))
    logged = means.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "key", "mean"))), ",").alias("logged"))
    return scores.join(F.broadcast(logged), F.lit(True))


def _layouts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Messages as result rows of each layout."""
    m = fx.conversations(spark, sf)
    role, text = F.col("role"), F.col("text")
    none = F.lit(None).cast("string")
    nested = m.select(
        "conv_id",
        "turn",
        F.struct(
            F.when(role == "user", F.struct(F.lit("").alias("question"), text.alias("input"))).alias("inputs"),
            F.when(role == "assistant", text).otherwise(none).alias("question"),
        ).alias("request"),
        F.struct(
            F.when(role == "user", F.struct(text.alias("answer"))).alias("outputs"),
            F.when(role == "assistant", text).otherwise(none).alias("content"),
        ).alias("response"),
    )
    return {
        "nested": nested,
        "json": evaluation.parse_json_layout(
            nested.select(
                "conv_id", "turn", F.to_json("request").alias("request"), F.to_json("response").alias("response")
            ),
            {
                "request": "inputs struct<question string, input string>, question string",
                "response": "outputs struct<answer string>, content string",
            },
        ),
        "plain_request": m.select("conv_id", "turn", text.alias("request"), text.alias("response")),
        "dict": m.select(
            "conv_id",
            "turn",
            F.create_map(F.lit("question"), text).alias("inputs"),
            F.create_map(role, text).alias("outputs"),
        ),
        "text": m.select("conv_id", "turn", text.alias("inputs"), role.alias("outputs")),
        "columns": m.select("conv_id", "turn", role.alias("question"), text.alias("answer")),
        "none": m.select("conv_id", "turn"),
    }


def _extracted(spark: SparkSession, sf: str, extract, name: str) -> DataFrame:
    parts = [
        df.select(F.lit(layout).alias("layout"), "conv_id", "turn", extract(df).alias(name))
        for layout, df in _layouts(spark, sf).items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def extract_question(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf, evaluation.extract_question, "question")


def extract_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf, evaluation.extract_answer, "answer")


def score_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = score_all(_paired(spark, sf)).withColumnRenamed("grounding_evaluator/value", "other")
    return rows.select(
        "conv_id",
        *[evaluation.score_text(rows, w).alias(w) for w in ("accuracy", "grounding", "fluency")],
    )


def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = score_all(_paired(spark, sf))
    rows = rows.withColumn("accuracy_evaluator/value", F.col("`accuracy_evaluator/value`").cast("bigint"))
    shown = evaluation.report(rows, "conv_id")
    return shown.select("number", "question", "answer", "accuracy", F.round(F.col("relevance").cast("double"), 6).alias("relevance"), "grounding")


def eval_head(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.head(run_evaluation(spark, sf), "conv_id")


def stringify_complex(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.stringify_complex(fx.examples(spark, sf))


def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts observed while the result table is written."""
    counted, seen = evaluation.observed(_paired(spark, sf))
    tables.save_results(counted, "docqa_run_stats", new_folder(spark, "run_stats"))
    return spark.createDataFrame([(k, v) for k, v in seen.get.items()], "name string, value bigint")


# Tables

def save_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    tables.save_table(
        chunk_table(fx.sectioned(spark, sf), fx.ENCODER, file_name="file_name"),
        "docqa_chunks",
        new_folder(spark, "chunks"),
    )
    return tables.read_table(spark, "docqa_chunks").select(
        "chunk_key", "doc_id", "chunk_id", "chunked_text", "file_name", F.aggregate(
            "embedding", F.lit(0.0), lambda acc, x: acc + x
        ).alias("words")
    )


def saved_count(spark: SparkSession, sf: str) -> DataFrame:
    tables.save_table(fx.chunks(spark, sf), "docqa_counted", new_folder(spark, "counted"))
    return tables.saved_count(tables.read_table(spark, "docqa_counted"))


def chunk_preview(spark: SparkSession, sf: str) -> DataFrame:
    first = fx.chunks(spark, sf).orderBy("chunk_key").limit(5)  # only these are encoded
    return tables.preview_chunks(embed(first, "chunked_text", fx.ENCODER))


def embedding_dim(spark: SparkSession, sf: str) -> DataFrame:
    return tables.dim_range(fx.table(spark, sf, "embeddings"))


def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    return feed_between(*fx.versions(spark, sf), "doc_id")


def build_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_key")
    index = tables.build_index(rows, new_folder(spark, "index"), encoder="given")
    return index.select("chunk_key", F.size("embedding").cast("bigint").alias("dim"), F.round("norm", 6).alias("norm"))


def build_from_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to saved chunk table to published index."""
    _, index = index_documents(
        fx.sectioned(spark, sf), fx.ENCODER, "docqa_indexed", new_folder(spark, "index"), new_folder(spark, "chunks")
    )
    return index.select("chunk_key", F.round("norm", 6).alias("norm"))


def sync_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index of the old vectors, brought to the new ones by a triggered stream of changes."""
    old, new = fx.vector_versions(spark, sf)
    path = new_folder(spark, "index")
    tables.build_index(old, path)
    inbox = new_folder(spark, "changes")
    feed_between(old, new, "chunk_key").withColumn("_commit_version", F.lit(1).cast("bigint")).write.parquet(inbox)
    stream = spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox)
    jobs.sync_index(stream, path, new_folder(spark, "checkpoint")).awaitTermination()
    return synced_index(spark, path).select(
        "chunk_key", F.size("embedding").cast("bigint").alias("dim"), F.round("norm", 6).alias("norm")
    )


def save_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.score_accuracy(_paired(spark, sf)).drop("context_text")
    tables.save_results(rows, "docqa_eval_results", new_folder(spark, "results"))
    return spark.table("docqa_eval_results").select(
        "conv_id", "inputs", "expectations", "tags", "answer", "accuracy_share"
    )


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics and result rows of an evaluation, logged and read back."""
    path = new_folder(spark, "runs")
    scored = score_all(_paired(spark, sf))
    values = F.create_map("metric", F.col("value").cast("string"))
    runlog.log_rows(evaluation.metrics(scored).select(values.alias("values")), "evaluation", "metric", path)
    runlog.log_table(scored.select("conv_id", "answer"), "evaluation", "eval_results_table", path)
    runlog.log_run(spark, "evaluation", "tag", {"task": "evaluation", "evaluation_type": "answer_quality"}, path)
    rows = runlog.read_log(spark, path)
    number = F.when(F.col("kind") == "metric", F.round(F.col("value").cast("double"), 6))
    return rows.select(
        "run_name", "kind", "key", F.when(F.col("kind") != "metric", F.col("value")).alias("value"), number.alias("number")
    )


# Streams

def chat_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Streamed messages, each conversation's open question answered from a saved index, replies in pieces."""
    docs = fx.sectioned(spark, sf)
    chunks, index = index_documents(
        docs, fx.ENCODER, "docqa_chat_chunks", new_folder(spark, "index"), new_folder(spark, "chunks")
    )

    def reply(opened: DataFrame) -> DataFrame:
        asked = opened.withColumnRenamed("conv_id", "query_id")
        return answer(asked, index, chunks, fx.ENCODER, K).withColumnRenamed("query_id", "conv_id")

    out = new_folder(spark, "chat")
    messages = fx.streamed(spark, sf, "conversations")
    jobs.chat_stream(fx.with_gaps(messages), reply, out, new_folder(spark, "checkpoint")).awaitTermination()
    return jobs.reply_pieces(spark, out).select(
        "conv_id", "message_id", F.col("pos").cast("bigint").alias("pos"), "content"
    )


def index_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Streamed documents, chunked and embedded as they arrive."""
    out = new_folder(spark, "stream_index")
    docs = fx.streamed(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n \n")).alias("text"))
    jobs.index_stream(docs, out, new_folder(spark, "checkpoint"), fx.ENCODER).awaitTermination()
    return jobs.streamed_chunks(spark, out).select(
        "chunk_key", "chunked_text", F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x).alias("words")
    )


def chunk_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks straight from pages, whose sections may run over page ends."""
    return chunking.chunk_pages(fx.section_pages(spark, sf))


def reindex_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Documents streamed into an empty searchable index, then edits, arrivals and removals; each chunk with the words of its vector."""
    old, new = fx.versions(spark, sf)
    out, path, inbox, checkpoint = (new_folder(spark, name) for name in ("documents", "index", "inbox", "checkpoint"))
    empty_index(spark, path, fx.ENCODER)
    text = F.replace("text", F.lit("\n"), F.lit("\n \n")).alias("text")
    first = old.select("doc_id", text, F.lit(1).alias("version"), F.lit(False).alias("deleted"))
    changes = feed_between(old, new, "doc_id").filter(F.col("_change_type") != "update_preimage")
    second = changes.select("doc_id", text, F.lit(2).alias("version"), (F.col("_change_type") == "delete").alias("deleted"))
    for rows in (first, second):
        rows.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        jobs.reindex_stream(stream, out, path, checkpoint, fx.ENCODER, version="version", deleted="deleted").awaitTermination()
    chunks = jobs.indexed_chunks(spark, out).select("chunk_key", "chunked_text")
    index = synced_index(spark, path).select("chunk_key", F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x).alias("words"))
    return index.join(chunks, "chunk_key")


QUERIES = {
    "file_select": file_select,
    "path_validate": path_validate,
    "base_name": file_base_name,
    "assemble_document": assemble_document,
    "document_stats": document_stats,
    "eval_examples": eval_examples,
    "normalize_newlines": normalized,
    "split_sections": sections,
    "section_title": section_titles,
    "section_content": section_contents,
    "chunk_documents": chunk_documents,
    "chunk_pages": chunk_pages,
    "chunk_count": chunk_count,
    "cast_embedding": cast_embedding,
    "truncate_answer": truncate_answer,
    "hash_embed": hash_embed,
    "japanese_embed": japanese_embed,
    "embed_udf": embed_udf,
    "tfidf_embed": tfidf_embed,
    "topk_dense": topk_dense,
    "topk_dot": topk_dot,
    "topk_l2": topk_l2,
    "topk_blocks": topk_blocks,
    "topk_certified": topk_certified,
    "topk_lsh": topk_lsh,
    "topk_sparse": topk_sparse,
    "topk_lists": topk_lists,
    "retrieve_with_text": retrieve_with_text,
    "context_count": context_count,
    "stuff_context": stuff_context,
    "render_prompt": render_prompt,
    "extractive_answer": extractive_answer,
    "answer_questions": answer_questions,
    "japanese_answers": japanese_answers,
    "generate_hook": generate_hook,
    "guarded_predict": guarded_predict,
    "last_user_message": last_user_message,
    "chat_fallback": chat_fallback,
    "chat_reply": chat_reply,
    "stream_chunks": stream_chunks,
    "run_evaluation": run_evaluation,
    "score_accuracy": score_accuracy,
    "score_relevance": score_relevance,
    "score_grounding": score_grounding,
    "align_answers": align_answers,
    "score_alignment": score_alignment,
    "eval_metrics": eval_metrics,
    "metrics_by_tag": metrics_by_tag,
    "evaluate_answers": evaluate_answers,
    "extract_question": extract_question,
    "extract_answer": extract_answer,
    "score_columns": score_columns,
    "eval_report": eval_report,
    "eval_head": eval_head,
    "stringify_complex": stringify_complex,
    "run_stats": run_stats,
    "save_roundtrip": save_roundtrip,
    "saved_count": saved_count,
    "chunk_preview": chunk_preview,
    "embedding_dim": embedding_dim,
    "change_feed": change_feed,
    "build_index": build_index,
    "index_documents": build_from_documents,
    "sync_index": sync_index,
    "save_results": save_results,
    "run_log": run_log,
    "chat_stream": chat_stream,
    "index_stream": index_stream,
    "reindex_stream": reindex_stream,
}
