"""Streamed documents in the searchable index, and chunks from pages."""

import random

import pytest
from pyspark.sql import functions as F

from docqa.operators.chunking import chunk_documents, chunk_pages
from docqa.operators.embedding import VECTOR_TYPE, HashEncoder
from docqa.operators.retrieval import topk
from docqa.plans.index import chunk_table, empty_index, fold_changes, synced_index
from docqa.sources.reading import assemble_document
from docqa.streaming import jobs
from docqa.workspace import new_folder

SCHEMA = "doc_id long, text string, version long, deleted boolean"


class Counting:
    """Letter counts as vectors; counts the texts it is given."""

    name, dim = "counting", 4

    def __init__(self, spark):
        self.seen = seen = spark.sparkContext.accumulator(0)

        def encode(text):
            seen.add(1)
            return [float(text.count(c)) for c in "abcd"]

        self.udf = F.udf(encode, VECTOR_TYPE).asNondeterministic()

    def column(self, text):
        return self.udf(text)


def state(spark, path, out):
    index = {r.chunk_key: tuple(r.embedding) for r in synced_index(spark, path).collect()}
    chunks = {r.chunk_key: r.chunked_text for r in jobs.indexed_chunks(spark, out).collect()}
    assert index.keys() == chunks.keys()
    return {k: (chunks[k], index[k]) for k in index}


def test_edits_removals_and_late_versions_reach_the_index(spark):
    encoder = Counting(spark)
    out, path, inbox, checkpoint = (new_folder(spark, n) for n in ("out", "index", "inbox", "checkpoint"))
    empty_index(spark, path, encoder)
    now = {}

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SCHEMA).parquet(inbox)
        before = encoder.seen.value
        jobs.reindex_stream(stream, out, path, checkpoint, encoder, version="version", deleted="deleted").awaitTermination()
        for d, text, version, gone in rows:
            if version >= now.get(d, (0,))[0]:
                now[d] = (version, None if gone else text)
        docs = spark.createDataFrame([(d, t) for d, (_, t) in now.items() if t is not None] or [(0, "")], "doc_id long, text string")
        want = {r.chunk_key: (r.chunked_text, tuple(float(r.chunked_text.count(c)) for c in "abcd")) for r in chunk_documents(docs).collect()}
        assert state(spark, path, out) == want
        return encoder.seen.value - before

    assert feed([(1, "aa\n \nbb\n \ncc", 1, False), (2, "dd\n \naa", 1, False), (3, "one", 1, False)]) == 6
    assert feed([(1, "aa\n \nbx\n \ncc", 2, False)]) == 1  # an edit
    assert feed([(1, "new\n \naa\n \nbx\n \ncc", 3, False)]) == 1  # chunks that only move
    assert feed([(1, "aa\n \ncc", 4, False), (2, None, 2, True)]) == 0  # a shorter text and a removal
    assert feed([(1, "stale", 2, False), (3, "one", 2, False)]) == 0  # an old version, and the same text again
    assert feed([(2, "back\n \ndd", 3, False), (4, "", 1, False)]) == 2  # a removed document comes back
    before = state(spark, path, out)
    fold_changes(spark, path)
    assert state(spark, path, out) == before
    assert feed([(3, None, 9, True)]) == 0


def test_search_in_a_streamed_index_equals_one_built_at_once(spark):
    encoder = HashEncoder(64)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n \n")).alias("text"))
    out, path, inbox, checkpoint = (new_folder(spark, n) for n in ("out", "index", "inbox", "checkpoint"))
    empty_index(spark, path, encoder)
    docs.repartition(3).write.parquet(inbox)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    jobs.reindex_stream(stream, out, path, checkpoint, encoder).awaitTermination()
    asked = chunk_table(docs.limit(20), encoder).select(F.col("chunk_key").alias("query_id"), "embedding")
    at_once = chunk_table(docs, encoder).select("chunk_key", "embedding")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(topk(asked, synced_index(spark, path).select("chunk_key", "embedding"))) == key(topk(asked, at_once))


def test_repeated_documents_without_versions_fail(spark):
    encoder = HashEncoder(8)
    out, path, inbox, checkpoint = (new_folder(spark, n) for n in ("out", "index", "inbox", "checkpoint"))
    empty_index(spark, path, encoder)
    spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string").coalesce(1).write.parquet(inbox)
    stream = spark.readStream.schema("doc_id long, text string").parquet(inbox)
    with pytest.raises(Exception, match="version column"):
        jobs.reindex_stream(stream, out, path, checkpoint, encoder).awaitTermination()


@pytest.mark.parametrize("collapse", [True, False])
def test_chunks_of_pages_equal_those_of_the_assembled_text(spark, collapse):
    rng = random.Random(7)
    bits = ["第1条 題", "第 ２ 条", "text", " ", "\n", "\n", "\n \n", "　", "x y", "\n\n", "第3条", "\t", "\x1c", "末尾"]
    rows = [(d if d else None, p, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))) for d in range(150) for p in range(rng.randrange(1, 6))]
    rows += [(1000, p, None if p % 7 == 0 else f"line {p}" + "\n \n" * (p % 5 == 0)) for p in range(2000)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string").repartition(7)
    want = chunk_documents(assemble_document(pages), collapse=collapse).select("doc_id", "chunk_id", "chunked_text")
    got = chunk_pages(pages, collapse=collapse).select("doc_id", "chunk_id", "chunked_text")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_document_of_many_pages_is_never_one_row(spark):
    pages = spark.range(100_000).selectExpr("1 AS doc_id", "id AS page_no", "concat('page ', id, repeat(' word', 20), case when id % 10 = 9 then '\n ' else '' end) AS text")
    made = chunk_pages(pages)
    assert made.count() == 10_000 and made.agg(F.max(F.length("chunked_text"))).first()[0] < 2000
    assert "collect_list" not in made._jdf.queryExecution().executedPlan().toString()
    assert chunk_pages(pages.limit(0)).count() == 0


def chat(spark, out, checkpoint, inbox, rows, **options):
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    df = spark.createDataFrame([(*r[:4], None if r[4] is None else f"2024-01-01 {r[4]}") for r in rows], "conv_id long, turn long, role string, text string, ts string")
    df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(schema).parquet(inbox)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    jobs.chat_stream(stream, lambda df: df.withColumn("answer", F.col("question")), out, checkpoint, ts_col="ts", **options).awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_late_messages_are_put_aside_and_idle_questions_stay(spark):
    out, checkpoint, inbox = (new_folder(spark, n) for n in ("chat", "checkpoint", "inbox"))
    go = lambda rows: chat(spark, out, checkpoint, inbox, rows, delay="10 minutes", idle_seconds=3600)
    go([(1, 0, "user", "first", "10:00:00"), (2, 0, "user", "other", "10:00:00"), (3, 0, "system", "hello", None)])
    go([(1, 4, "user", "late", "09:30:00"), (1, 1, "assistant", "reply", "10:05:00"), (2, 1, "user", "within", "09:55:00")])
    opened = lambda: {r.conv_id: r.question for r in jobs.open_questions(spark, out).collect()}
    assert opened() == {1: "first", 2: "within", 3: ""}
    assert [tuple(r)[:4] for r in jobs.late_messages(spark, out).collect()] == [(1, 4, "user", "late")]
    assert jobs.idle_conversations(spark, out).count() == 0
    go([(3, 1, "user", "now", "12:00:00")])
    assert {tuple(r) for r in jobs.idle_conversations(spark, out).collect()} == {(1, 1, "first"), (2, 1, "within")}
    go([(1, 5, "assistant", "more", "12:30:00")])  # the idle conversation goes on, and its question is still there
    assert opened() == {1: "first", 2: "within", 3: "now"}
    pieces = {r.conv_id: r.content for r in jobs.reply_pieces(spark, out).collect()}
    assert pieces[1] == "first" and pieces[3] == "now"


def test_forgotten_conversations_begin_anew(spark):
    out, checkpoint, inbox = (new_folder(spark, n) for n in ("chat", "checkpoint", "inbox"))
    go = lambda rows: chat(spark, out, checkpoint, inbox, rows, idle_seconds=600, forget_seconds=3600)
    go([(1, 0, "user", "first", "10:00:00")])
    go([(2, 0, "user", "x", "10:30:00")])
    go([(2, 1, "user", "y", "13:00:00")])
    go([(1, 1, "assistant", "later", "14:00:00")])
    assert {r.conv_id: r.question for r in jobs.open_questions(spark, out).collect()} == {1: "", 2: "y"}
