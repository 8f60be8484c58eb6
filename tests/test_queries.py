"""Every registered query against its SQL on the smallest tables, and what the plans must not contain."""

import glob
import os

import duckdb
import pytest

from check import rows_of
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"

NATIVE = [
    "normalize_newlines", "split_sections", "section_title", "section_content", "chunk_documents", "hash_embed",
    "last_user_message", "chat_reply", "stream_chunks", "run_evaluation", "score_accuracy", "score_relevance",
    "score_grounding", "eval_metrics", "metrics_by_tag", "extract_question", "eval_report", "change_feed",
]
NARROW = ["normalize_newlines", "split_sections", "chunk_documents", "hash_embed", "stream_chunks"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_stays_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "InArrow" not in text and "InPandas" not in text
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", NARROW)
def test_text_work_is_narrow(spark, name):
    """The only exchange allowed is the even spreading of a small input."""
    lines = [x for x in plan(spark, name).splitlines() if "Exchange" in x]
    assert all("RoundRobinPartitioning" in x for x in lines)
