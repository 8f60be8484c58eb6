"""Result layouts, scores, metrics, report."""

import re

import pytest
from pyspark.sql import functions as F

from docqa.operators import evaluation as ev
from docqa.plans.evaluate import evaluate
from docqa.operators import runlog
from docqa.operators.runlog import read_log
from docqa.workspace import new_folder


def both(df):
    return tuple(df.select(ev.extract_question(df).alias("q"), ev.extract_answer(df).alias("a")).first())


def test_layouts(spark):
    make = spark.createDataFrame
    assert both(
        make([((("q", None),), (("a",),))], "request struct<inputs struct<question string, input string>>, response struct<outputs struct<answer string>>")
    ) == ("q", "a")
    assert both(
        make([((("", "i"),), ("c",))], "request struct<inputs struct<question string, input string>>, response struct<content string>")
    ) == ("i", "c")
    assert both(make([("text", ("q",), "a")], "request string, inputs struct<question string>, response string")) == ("N/A", "N/A")
    assert both(make([("text", (None,))], "inputs string, outputs struct<answer string>")) == ("text", "")
    assert both(make([("q", "a")], "question string, answer string")) == ("q", "a")
    assert both(make([("x",)], "other string")) == ("N/A", "N/A")
    assert both(make([({"input": "i"}, {"x": "y"})], "inputs map<string,string>, outputs map<string,string>")) == ("i", "")
    assert both(make([(("i",), ("a",))], "request struct<input string>, response struct<answer string>")) == ("i", "a")


def test_json_layout(spark):
    df = spark.createDataFrame([('{"inputs":{"question":"q"}}', '{"outputs":{"answer":"a"}}')], "request string, response string")
    assert both(df) == ("N/A", "N/A")
    parsed = ev.parse_json_layout(
        df, {"request": "inputs struct<question string>", "response": "outputs struct<answer string>"}
    )
    assert both(parsed) == ("q", "a")


def test_score_column():
    assert ev.score_column(["accuracy_note", "Accuracy_x/value"], "accuracy") == "Accuracy_x/value"
    assert ev.score_column(["accuracy_note"], "accuracy") == "accuracy_note"
    assert ev.score_column(["other"], "accuracy") is None


def test_scores(spark):
    df = spark.createDataFrame(
        [
            ("red fish", "Red fish swim.", ["Red", "swim"], "red fish swim"),
            ("red fish", "blue birds fly", ["Red", "birds"], "birds"),
            ("", "", ["x"], None),
        ],
        "question string, answer string, facts array<string>, context_text string",
    )
    df = ev.score_grounding(ev.score_relevance(ev.score_accuracy(df, facts="facts"), "question"))
    got = [
        (r["accuracy_share"], r["accuracy_evaluator/value"], r["relevance_evaluator/value"], r["grounding_evaluator/value"])
        for r in df.collect()
    ]
    assert got == [(1.0, 1, 1.0, "excellent"), (0.5, 0, 0.0, "acceptable"), (0.0, 0, 0.0, "poor")]


def test_numbering_is_global_without_one_task(spark):
    ids = [i * i % 1009 for i in range(500)]
    ids = sorted(set(ids))
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "id bigint").repartition(7)
    got = {r.id: r.number for r in ev.number_rows(df, "id", pieces=8).collect()}
    assert got == {i: n + 1 for n, i in enumerate(ids)}
    plan = ev.number_rows(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_result_table_choice(spark):
    df = spark.range(1)
    assert ev.result_table(df) is df
    assert ev.result_table(None, {"eval_results_table": df}) is df
    with pytest.raises(ValueError):
        ev.result_table(None, {"x": df})


def test_stringify_leaves_scalars(spark):
    df = spark.createDataFrame([(1, {"a": "b"}, [1, 2], ("s",))], "i int, m map<string,string>, l array<int>, `s/t` struct<x string>")
    assert tuple(ev.stringify_complex(df).first()) == (1, '{"a":"b"}', "[1,2]", '{"x":"s"}')


def test_evaluation_run_is_saved_and_logged(spark):
    from docqa.sources.reading import eval_examples

    rows = [
        {"inputs": {"question": f"question {i}"}, "expectations": {"expected_facts": ["fact"]}, "tags": {"category": "c", "difficulty": "easy"}}
        for i in range(4)
    ]
    examples = eval_examples(spark, rows).withColumn("id", F.regexp_extract("inputs.question", r"\d", 0).cast("bigint"))
    answers = spark.createDataFrame([(0, "a fact", "a fact"), (1, "none", None)], "id bigint, answer string, context_text string")
    log = new_folder(spark, "log")
    saved = evaluate(examples, answers, "id", "run", "eval_test_results", new_folder(spark, "r"), log)
    assert saved.count() == 4
    logged = {(r.kind, r.key): r.value for r in read_log(spark, log).collect()}
    assert logged[("metric", "examples")] == "4" and logged[("metric", "empty_answers")] == "2"
    assert logged[("metric", "accuracy_evaluator/mean")] == "0.25"
    assert ("metric", "evaluation_time_seconds") in logged and ("table", "eval_results_table") in logged
    by_tag = ev.metrics_by_tag(
        ev.score_grounding(ev.score_relevance(ev.score_accuracy(ev.run_evaluation(examples, answers, "id")))), ["difficulty"]
    )
    assert {(r.difficulty, r.examples) for r in by_tag.collect()} == {("easy", 4), (None, 4)}


def test_judge_hook(spark):
    def make():
        return lambda prompts: ["good" if p.endswith("yes") else "poor" for p in prompts]

    df = spark.createDataFrame([(("q",), "yes", "c"), (("q",), "no {answer}", None)], "inputs struct<question string>, answer string, context_text string")
    judged = ev.judge(df, make)
    assert [r["grounding_evaluator/value"] for r in judged.collect()] == ["good", "poor"]
    assert ev.score_column(judged.columns, "grounding") == "grounding_evaluator/value"


def test_numbering_of_string_null_and_tied_keys_reads_the_input_once(spark):
    rows = [(f"k{i % 40}", i) for i in range(300)] + [(None, -1), (None, -2), ("k1", 1), ("é", 0), ("", 0)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def watched(x):
        seen.add(1)
        return x

    df = spark.createDataFrame(rows, "key string, v long").select("key", watched.asNondeterministic()("v").alias("v"))
    got = sorted(ev.number_rows(df, "key", pieces=7).collect(), key=lambda r: r.number)
    assert seen.value == len(rows)
    assert [r.number for r in got] == list(range(1, len(rows) + 1))
    assert sorted((r.key is not None, r.key or "", r.v) for r in got) == sorted((k is not None, k or "", v) for k, v in rows)
    keys = [(r.key is not None, (r.key or "").encode()) for r in got]
    assert keys == sorted(keys)
    assert ev.number_rows(df.limit(0), "key").count() == 0
    again = {(r.key, r.v, r.number) for r in ev.number_rows(df.repartition(3), "key").collect()}
    assert again == {(r.key, r.v, r.number) for r in got}


def test_a_missing_tag_is_not_the_total(spark):
    rows = [({"category": "a"}, 1.0), ({"category": "b", "level": "x"}, 0.0), ({}, 0.5)]
    df = spark.createDataFrame(rows, "tags map<string,string>, s double")
    got = {(r.tag, r.category, r.level): (r.examples, r.m) for r in ev.metrics_by_tag(df, ["category", "level"], {"m": "s"}).collect()}
    assert got == {("category", "a", None): (1, 1.0), ("category", "b", None): (1, 0.0), ("category", None, None): (1, 0.5), ("level", None, "x"): (1, 0.0), ("level", None, None): (2, 0.75), (None, None, None): (3, 0.5)}


def test_two_runs_of_one_name_are_told_apart(spark):
    path = new_folder(spark, "runs")
    for x in (1, 2):
        runlog.log_run(spark, "same", "metric", {"x": x}, path, runlog.new_run_id())
    rows = runlog.read_log(spark, path).collect()
    assert len({r.run_id for r in rows}) == 2 and {r.run_name for r in rows} == {"same"}


def test_longest_runs_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(61)
    for _ in range(400):
        a, b = rng.integers(0, 4, rng.integers(0, 25)), rng.integers(0, 4, rng.integers(0, 60))
        best = (0, -1)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0] or n == best[0] and n and j < best[1]:
                    best = (n, j)
        assert ev.longest_run(a, b) == best
    long = rng.integers(0, 50_000, 300_000)
    assert ev.longest_run(long[1000:41_000], long) == (40_000, 1000)


def test_alignment_of_null_and_empty_answers(spark):
    rows = [(1, None, "a b"), (2, "", "a b"), (3, "Red fish swim. Blue birds fly away.", "The red fish swim on."), (4, "Words here", None), (5, "通勤手当を払う。", "会社は通勤手当を払う")]
    df = spark.createDataFrame(rows, "id int, answer string, context_text string")
    got = {r.id: (r.covered_share, r["alignment_evaluator/value"]) for r in ev.score_alignment(df, ["id"]).collect()}
    assert got == {1: (0.0, "poor"), 2: (0.0, "poor"), 3: (0.5, "good"), 4: (0.0, "poor"), 5: (1.0, "excellent")}
    third = ev.align_answers(df, ["id"]).filter("id = 3").orderBy("sentence_no").collect()
    assert [(r.run, r.evidence_at, r.evidence) for r in third] == [(3, 1, "red fish swim"), (0, -1, "")]


def test_runs_by_pairs_equal_runs_by_hashes(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(62)
    pairs = [(rng.integers(0, 3, rng.integers(0, 20)), rng.integers(0, 3, rng.integers(0, 80))) for _ in range(300)]
    monkeypatch.setattr(ev, "GRID_CELLS", 0)
    hashed = [ev.longest_run(a, b) if len(a) and len(b) else (0, -1) for a, b in pairs]
    monkeypatch.undo()
    monkeypatch.setattr(ev, "_rolled", None)  # a sentence of a few words takes no hashes
    assert [ev.longest_run(a, b) for a, b in pairs] == hashed


def test_alignment_numbers_words_in_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(63)
    known = [[f"w{i}" for i in rng.integers(0, 6, rng.integers(0, 40))] for _ in range(60)]
    parts = [[[f"w{i}" for i in rng.integers(0, 6, rng.integers(1, 9))] for _ in range(rng.integers(1, 5))] for _ in known]
    number = lambda x: np.array([int(w[1:]) for w in x], dtype=np.int64)
    want = [[dict(zip(("run", "at"), ev.longest_run(number(p), number(k)))) for p in ps] for ps, k in zip(parts, known)]
    p, k = pa.array(parts, pa.list_(pa.list_(pa.string()))), pa.array(known, pa.list_(pa.string()))
    for bound in (1, 50, 1 << 20):
        monkeypatch.setattr(ev, "WORDS_AT_ONCE", bound)
        pieces = list(ev._together(p, k))
        assert [x for lo, n in pieces for x in range(lo, lo + n)] == list(range(60))
        assert all(n == 1 or sum(map(len, known[lo : lo + n])) <= bound for lo, n in pieces)
        assert [r for lo, n in pieces for r in ev._aligned(p.slice(lo, n), k.slice(lo, n)).to_pylist()] == want


def test_rows_of_sentences_do_not_carry_the_context(spark):
    df = spark.createDataFrame([(1, "Red fish swim. Blue birds.", "The red fish swim on.")], "id int, answer string, context_text string")
    plan = ev.align_answers(df, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    left_behind = re.search(r"Generate posexplode.*?\[([\d, ]*)\], false, \[sentence_no", plan, re.S)
    assert left_behind and len(left_behind[1].split(",")) == 3  # the sentences, the context's words and the runs; only the key goes on
    assert plan.count("[^.!?") == 1  # sentences are cut once
