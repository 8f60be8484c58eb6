"""Change feeds, index versions, triggered streams fed by several files."""

import pytest
from pyspark.sql import functions as F

from docqa.config import setting
from docqa.operators.changes import apply_changes, change_feed
from docqa.operators.chat import last_user_message
from docqa.operators.embedding import HashEncoder
from docqa.operators.runlog import log_run, read_log
from docqa.plans.index import chunk_table, fold_changes, index_documents, synced_index
from docqa.sources import reading, tables
from docqa.streaming import jobs
from docqa.workspace import new_folder, settle
from workload.queries import QUERIES


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_feed_applied_to_old_gives_new(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "k bigint, v string")
    new = spark.createDataFrame([(2, None), (3, "x"), (4, None), (5, "e")], "k bigint, v string")
    feed = change_feed(old, new, "k")
    kinds = {(r.k, r._change_type) for r in feed.collect()}
    assert kinds == {
        (1, "delete"), (5, "insert"),
        (3, "update_preimage"), (3, "update_postimage"), (4, "update_preimage"), (4, "update_postimage"),
    }
    assert rows(apply_changes(old, feed.withColumn("_commit_version", F.lit(1)), "k")) == rows(new)
    assert change_feed(new, new, "k").count() == 0


def vectors(spark, pairs):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in pairs], "chunk_key bigint, embedding array<float>")


def test_index_versions_and_checks(spark):
    path = new_folder(spark, "ix")
    index = tables.build_index(vectors(spark, [(1, (3, 4)), (2, (0, 1))]), path, encoder="e1")
    assert {(r.chunk_key, r.norm) for r in index.collect()} == {(1, 5.0), (2, 1.0)}
    with pytest.raises(ValueError, match="not unique"):
        tables.build_index(vectors(spark, [(1, (3, 4)), (1, (0, 1))]), path, encoder="e1")
    with pytest.raises(ValueError, match="dimension"):
        tables.build_index(vectors(spark, [(1, (3, 4)), (2, (0,))]), path, encoder="e1")
    assert tables.read_index(spark, path, "e1").count() == 2
    with pytest.raises(ValueError, match="encoder"):
        tables.read_index(spark, path, "e2")
    tables.build_index(vectors(spark, [(9, (1, 1))]), path, encoder="e1")
    assert [r.chunk_key for r in tables.read_index(spark, path).collect()] == [9]
    with pytest.raises(FileNotFoundError):
        tables.read_index(spark, path + "x")


@pytest.mark.parametrize("planes", [0, 3])
def test_sync_in_several_commits_then_fold(spark, planes):
    path, inbox, checkpoint = (new_folder(spark, n) for n in ("ix", "in", "cp"))
    states = [
        vectors(spark, [(1, (1, 0)), (2, (0, 1)), (3, (2, 2))]),
        vectors(spark, [(1, (5, 0)), (3, (2, 2)), (4, (1, 1))]),
        vectors(spark, [(2, (0, 9)), (3, (2, 2)), (4, (7, 1))]),
    ]
    tables.build_index(states[0], path, encoder="e", planes=planes, dim=2)
    assert rows(synced_index(spark, path).select("chunk_key", "embedding")) == rows(states[0])
    schema = change_feed(states[0], states[1], "chunk_key").withColumn("_commit_version", F.lit(1).cast("bigint")).schema
    for version in (1, 2):
        feed = change_feed(states[version - 1], states[version], "chunk_key")
        feed.withColumn("_commit_version", F.lit(version).cast("bigint")).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        jobs.sync_index(stream, path, checkpoint).awaitTermination()
        assert rows(synced_index(spark, path).select("chunk_key", "embedding")) == rows(states[version])
    folded = fold_changes(spark, path)
    assert rows(folded.select("chunk_key", "embedding")) == rows(states[2])
    assert rows(synced_index(spark, path).select("chunk_key", "embedding")) == rows(states[2])
    assert ("cell" in folded.columns) == bool(planes)
    assert tables.index_details(folded)["encoder"] == "e"


def test_streamed_documents_equal_batch_and_replace_older_versions(spark):
    inbox, out, checkpoint = (new_folder(spark, n) for n in ("docs", "out", "cp"))
    encoder = HashEncoder(32)
    first = spark.createDataFrame([(1, "a\n \nb\n \nc"), (2, "x")], "doc_id bigint, text string")
    second = spark.createDataFrame([(1, "a\n \nz"), (2, ""), (3, "n")], "doc_id bigint, text string")
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(part.schema).parquet(inbox)
        jobs.index_stream(stream, out, checkpoint, encoder).awaitTermination()
    assert rows(jobs.streamed_chunks(spark, out)) == rows(
        chunk_table(second, encoder).select(*jobs.streamed_chunks(spark, out).columns)
    )


CHANGES = "chunk_key bigint, embedding array<float>, _change_type string, _commit_version bigint"


def add_changes(spark, inbox, rows):
    spark.createDataFrame([(k, [1.0, float(k)], "insert", v) for k, v in rows], CHANGES).coalesce(1).write.mode("append").parquet(inbox)
    return spark.readStream.schema(CHANGES).parquet(inbox)


def test_one_commit_in_two_batches_with_a_fold_between(spark):
    path, inbox, checkpoint = (new_folder(spark, n) for n in ("ix", "in", "cp"))
    tables.build_index(vectors(spark, [(0, (1, 0))]), path)
    jobs.sync_index(add_changes(spark, inbox, [(1, 1)]), path, checkpoint).awaitTermination()
    fold_changes(spark, path)
    jobs.sync_index(add_changes(spark, inbox, [(2, 1)]), path, checkpoint).awaitTermination()
    assert sorted(r.chunk_key for r in synced_index(spark, path).collect()) == [0, 1, 2]


def test_a_new_checkpoint_keeps_earlier_changes(spark):
    path = new_folder(spark, "ix")
    tables.build_index(vectors(spark, [(0, (1, 0))]), path)
    for key in (1, 2):
        stream = add_changes(spark, new_folder(spark, "in"), [(key, key)])
        jobs.sync_index(stream, path, new_folder(spark, "cp")).awaitTermination()
    assert sorted(r.chunk_key for r in synced_index(spark, path).collect()) == [0, 1, 2]


def test_versions_of_a_document(spark):
    inbox, out, checkpoint = (new_folder(spark, n) for n in ("docs", "out", "cp"))
    encoder, schema = HashEncoder(8), "doc_id bigint, text string, v int"
    for part in ([(1, "old", 1), (1, "new", 2), (2, "x", 5)], [(2, "older", 4)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        jobs.index_stream(spark.readStream.schema(schema).parquet(inbox), out, checkpoint, encoder, version="v").awaitTermination()
    assert {(r.chunk_key, r.chunked_text) for r in jobs.streamed_chunks(spark, out).collect()} == {("1:0", "new"), ("2:0", "x")}
    stream = spark.readStream.schema(schema).parquet(inbox)
    with pytest.raises(Exception, match="another stream"):
        jobs.index_stream(stream, out, new_folder(spark, "cp"), encoder, version="v").awaitTermination()
    with pytest.raises(Exception, match="repeats a document"):
        jobs.index_stream(stream, new_folder(spark, "out"), new_folder(spark, "cp"), encoder).awaitTermination()


MESSAGES = "conv_id bigint, turn bigint, role string, text string"


def test_streamed_chat_equals_batch(spark):
    inbox, out, checkpoint = (new_folder(spark, n) for n in ("talk", "out", "cp"))
    parts = [
        [(1, 0, "user", "first"), (2, 0, "system", "s"), (3, 1, "user", "late")],
        [(1, 1, "assistant", "reply"), (1, 2, "user", "second"), (3, 0, "user", "early")],
        [(2, 1, "user", "now"), (4, 0, "user", "")],
    ]
    for part in parts:
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(inbox)
    echo = lambda df: df.withColumn("answer", F.concat(F.lit("re "), "question"))
    jobs.chat_stream(stream, echo, out, checkpoint).awaitTermination()
    batch = last_user_message(spark.read.schema(MESSAGES).parquet(inbox))
    assert rows(jobs.open_questions(spark, out)) == rows(batch)
    pieces = {r.conv_id: r.content for r in jobs.reply_pieces(spark, out).collect()}
    assert pieces == {1: "re second", 2: "re now", 3: "re late", 4: "ユーザーメッセージが見つかりませんでした。"}


def test_streamed_chat_with_time_column(spark):
    inbox, out, checkpoint = (new_folder(spark, n) for n in ("talk", "out", "cp"))
    schema = MESSAGES + ", ts timestamp"
    parts = [
        [(1, 0, "user", "first", "2024-01-01 00:00:00")],
        [(1, 2, "user", "second", "2024-01-01 00:10:00"), (1, 1, "assistant", "r", "2024-01-01 00:05:00")],
        [(2, 0, "system", "s", "2024-01-05 00:00:00")],
    ]
    for part in parts:
        df = spark.createDataFrame([r[:4] + (None,) for r in part], schema)
        times = spark.createDataFrame([(r[0], r[1], r[4]) for r in part], "conv_id bigint, turn bigint, t string")
        df = df.join(times, ["conv_id", "turn"]).withColumn("ts", F.col("t").cast("timestamp")).drop("t")
        df.select("conv_id", "turn", "role", "text", "ts").coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    echo = lambda df: df.withColumn("answer", F.col("question"))
    jobs.chat_stream(stream, echo, out, checkpoint, ts_col="ts").awaitTermination()
    assert {r.conv_id: r.question for r in jobs.open_questions(spark, out).collect()} == {1: "second", 2: ""}


def test_tables(spark):
    tables.ensure_schema(spark, "docqa_test")
    encoder = HashEncoder(32)
    docs = spark.createDataFrame([(1, "f.pdf", "a\n \nb")], "doc_id bigint, file_name string, text string")
    chunks, index = index_documents(
        docs, encoder, "docqa_test.chunks", new_folder(spark, "ix"), new_folder(spark, "t"), file_name="file_name"
    )
    assert chunks.columns == ["chunk_key", "doc_id", "chunk_id", "chunked_text", "file_name", "embedding"]
    assert tables.saved_count(chunks).first()["count"] == 2 and tables.embedding_dim(chunks) == 32
    assert [tuple(r) for r in tables.preview_chunks(chunks).collect()] == [("1:0", "f.pdf", 1, 32), ("1:1", "f.pdf", 1, 32)]
    tables.save_table(docs, "docqa_test.chunks", new_folder(spark, "t"))
    assert spark.table("docqa_test.chunks").columns == docs.columns
    out = new_folder(spark, "json")
    tables.export_results(chunks, out, "csv")
    assert spark.read.csv(out, header=True).count() == 2


def test_sources(spark, tmp_path):
    for name in ("b.PDF", "a.pdf", "c.txt"):
        (tmp_path / name).write_text("x")
    files = reading.list_files(spark, str(tmp_path))
    assert reading.select_files(files, "path", ".pdf").count() == 2
    assert reading.first_file(files, "path", ".pdf").endswith("a.pdf")
    with pytest.raises(FileNotFoundError):
        reading.first_file(files, "path", ".doc")
    good, bad = reading.split_valid_paths(files, "path", ".pdf")
    assert (good.count(), bad.count()) == (2, 1)
    pages = spark.createDataFrame(
        [(1, 10, "last"), (1, 2, "first"), (1, 3, " 　\n"), (2, 1, " ")], "doc_id bigint, page_no int, text string"
    )
    assert rows(reading.assemble_document(pages)) == [("1", "first\nlast", "3"), ("2", "", "1")]
    assert rows(reading.document_stats(pages)) == [("1", "10", "3"), ("2", "0", "1")]


def test_run_log(spark):
    path = new_folder(spark, "log")
    log_run(spark, "r", "param", {"k": 5}, path)
    log_run(spark, "r", "tag", {"task": "x"}, path)
    assert {(r.run_name, r.kind, r.key, r.value) for r in read_log(spark, path).collect()} == {("r", "param", "k", "5"), ("r", "tag", "task", "x")}
    with pytest.raises(ValueError):
        log_run(spark, "r", "other", {}, path)


def test_settle_computes_once(spark):
    df = settle(spark.range(5).withColumn("u", F.uuid()), "s")
    assert rows(df) == rows(df)


def test_settings(monkeypatch):
    monkeypatch.setenv("RETRIEVER_TOP_K", "7")
    monkeypatch.setenv("DELTA_TABLE_NAME", "")
    assert setting("k") == 7 and setting("k", 3) == 3
    assert setting("chunk_table") == "docqa_chunks" and setting("chunk_table", "s.t") == "s.t"


@pytest.mark.parametrize("bad", [None, [], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0]])
def test_unusable_vectors_fail_the_build(spark, tmp_path, bad):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", bad)], "chunk_key string, embedding array<float>")
    with pytest.raises(ValueError, match="no usable vector"):
        tables.build_index(df, str(tmp_path / "index"))
    assert not tables.published_versions(spark, str(tmp_path / "index"))


@pytest.mark.parametrize("parts", [None, 3])
def test_streamed_queries_read_tables_of_one_file_and_of_many(spark, tmp_path, parts):
    docs = spark.createDataFrame([(i, f"word{i} apples and pears\nline {i}", "en", f"src{i % 3}", 30) for i in range(1, 13)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    talks = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"word{c} apples {t}") for c in range(1, 7) for t in range(3)], "conv_id bigint, turn bigint, role string, text string")
    for name, df in (("documents", docs), ("conversations", talks)):
        if parts:
            df.repartition(parts).write.parquet(f"{tmp_path}/{name}.parquet")
        else:
            df.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    assert QUERIES["index_stream"](spark, str(tmp_path)).count() == 24
    pieces = QUERIES["chat_stream"](spark, str(tmp_path))
    assert pieces.filter("conv_id > 0").select("conv_id").distinct().count() == 6
