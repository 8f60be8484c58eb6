"""Scoring answers and reporting on them. Result layouts are resolved from the schema at plan time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docqa.functions.text import distinct_words, first_truthy, sentences, truncate_text, words
from docqa.operators.answering import fill_template, generate
from docqa.workspace import settle

# Text for an absent value, report answer length, and grounding bands.
ABSENT = "N/A"
REPORT_ANSWER_LENGTH = 300
BANDS = ("excellent", "good", "acceptable", "poor")
# Fixed value: what a judge is told about grounding.
GROUNDING_GUIDELINES = """回答が取得されたコンテキストに基づいているか（接地しているか）を評価してください。
以下の観点から評価してください：
1. 回答がコンテキストに基づいているか
2. 回答がコンテキストから推論できるか
3. 回答がコンテキストにない情報を含んでいないか

評価は以下のスケールで行ってください：
- 'excellent': 完全にコンテキストに基づいている
- 'good': 主にコンテキストに基づいている
- 'acceptable': 一部コンテキストに基づいている
- 'poor': コンテキストに基づいていない"""


def run_evaluation(examples: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Pair every example with its prediction; an example without one stays, with an empty answer."""
    paired = examples.join(answers, key, "left")
    return paired.withColumn("answer", F.coalesce("answer", F.lit("")))


def facts_present(answer: Column, facts: Column) -> Column:
    """Share of the expected facts that occur in the answer; null without facts."""
    found = F.filter(facts, lambda f: F.contains(answer, f))
    return F.try_divide(F.size(found).cast("double"), F.size(facts).cast("double"))


def words_covered(words_of: Column, text: Column) -> Column:
    """Share of the distinct words of one text that occur in another; 0 for a text without words."""
    own = distinct_words(words_of)
    shared = F.size(F.array_intersect(own, distinct_words(text))).cast("double")
    return F.coalesce(F.try_divide(shared, F.size(own).cast("double")), F.lit(0.0))


def score_accuracy(df: DataFrame, answer: str = "answer", facts: str = "expectations.expected_facts") -> DataFrame:
    return df.withColumn("accuracy_share", facts_present(F.col(answer), F.col(facts))).withColumn(
        "accuracy_evaluator/value", F.when(F.col("accuracy_share") == 1.0, 1).otherwise(0)
    )


def score_relevance(df: DataFrame, question: str = "inputs.question", answer: str = "answer") -> DataFrame:
    return df.withColumn("relevance_evaluator/value", words_covered(F.col(question), F.col(answer)))


def grounding_band(share: Column) -> Column:
    return (
        F.when(share == 1.0, BANDS[0]).when(share >= 0.5, BANDS[1]).when(share > 0.0, BANDS[2]).otherwise(BANDS[3])
    )


def score_grounding(df: DataFrame, answer: str = "answer", context: str = "context_text") -> DataFrame:
    share = words_covered(F.col(answer), F.coalesce(F.col(context), F.lit("")))
    return df.withColumn("grounding_share", share).withColumn(
        "grounding_evaluator/value", grounding_band(F.col("grounding_share"))
    )


RUN_SHARE = 0.5  # of a sentence's words that one run of the context must hold for it to count as covered
GRID_CELLS = 1 << 20  # pairs of a sentence's and a context's words that are compared one by one; beyond it windows are hashed
WORDS_AT_ONCE = 1 << 20  # words of rows that are numbered together; a longer row is taken alone


def longest_run(sentence: np.ndarray, context: np.ndarray) -> tuple[int, int]:
    """Length of the longest run of words of ``sentence`` that ``context`` holds as they stand, and where it first begins there.

    Words are numbers. Up to ``GRID_CELLS`` pairs are compared directly. Beyond that windows of one length are told apart by rolling
    hashes; since a common run holds shorter ones, the length is found by halving, so the work is in proportion to the words times the
    logarithm of the sentence's length.
    """
    if len(sentence) * len(context) <= GRID_CELLS:
        return _run_in_grid(sentence, context)
    mix = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)

    def windows(x: np.ndarray, n: int) -> np.ndarray:
        return _rolled(x, n, mix)

    low, high = 0, min(len(sentence), len(context))
    while low < high:
        n = (low + high + 1) // 2
        low, high = (n, high) if np.isin(windows(context, n), windows(sentence, n)).any() else (low, n - 1)
    return (low, int(np.isin(windows(context, low), windows(sentence, low)).argmax())) if low else (0, -1)


def _run_in_grid(sentence: np.ndarray, context: np.ndarray) -> tuple[int, int]:
    """``longest_run`` by the pairs of places from which on one word, then two, then three and so on are equal."""
    same = sentence[:, None] == context
    held, last, n = same, same, 0
    while held.any():
        last, n = held, n + 1
        held = held[:-1, :-1] & same[n:, n:]
    return (n, int(last.any(axis=0).argmax())) if n else (0, -1)


def _rolled(x: np.ndarray, n: int, mix: np.ndarray) -> np.ndarray:
    """A hash of each window of ``n`` numbers, by doubling: windows of powers of two are joined to the length."""
    hashes, size, out, done = x.astype(np.uint64) * mix + mix, 1, None, 0
    while True:
        if n & size:
            part = hashes[done:]
            out = part if out is None else out[: len(part)] * (mix + np.uint64(2 * size)) ^ part[: len(out)]
            done += size
        if done == n:
            return out[: len(x) - n + 1]
        ahead = hashes[size:]
        hashes = (hashes[: len(ahead)] * (mix + np.uint64(2 * size + 1))) ^ ((ahead << np.uint64(7)) | (ahead >> np.uint64(57)))
        size *= 2


def align_answers(df: DataFrame, key: Sequence[str], answer: str = "answer", context: str = "context_text") -> DataFrame:
    """One row a sentence of each answer: ``(*key, sentence_no, sentence, n_words, run, evidence_at, evidence, covered)``.

    ``run`` is the longest run of the sentence's words that the context holds as they stand, ``evidence_at`` the number of the word
    of the context where it first begins (from 0, -1 without one), ``evidence`` its words. A sentence is covered if the run is at
    least ``RUN_SHARE`` of its words. Answers without words give no rows; a null context holds no words.
    """
    kept = F.transform(sentences(F.coalesce(F.col(answer), F.lit(""))), lambda x: F.struct(x.alias("text"), words(x).alias("words")))
    kept = F.filter(kept, lambda x: F.size(x["words"]) > 0)
    rows = df.select(*key, kept.alias("_sentences"), words(F.coalesce(F.col(context), F.lit(""))).alias("_context"))

    @F.arrow_udf("array<struct<run:int,at:int>>")
    def runs(parts: pa.Array, known: pa.Array) -> pa.Array:
        pieces = [_aligned(parts.slice(lo, n), known.slice(lo, n)) for lo, n in _together(parts, known)]
        return pa.concat_arrays(pieces) if pieces else pa.array([], pa.list_(_RUN))

    rows = rows.withColumn("_runs", runs(F.transform("_sentences", lambda x: x["words"]), "_context"))

    def aligned(x, r):
        run, n = r["run"], F.size(x["words"])
        evidence = F.when(run > 0, F.array_join(F.slice("_context", r["at"] + 1, F.greatest(run, F.lit(1))), " ")).otherwise("")
        return F.struct(
            x["text"].alias("sentence"), n.cast("bigint").alias("n_words"), run.cast("bigint").alias("run"),
            r["at"].cast("bigint").alias("evidence_at"), evidence.alias("evidence"), (run >= RUN_SHARE * n).alias("covered"),
        )

    # The evidence is cut out before the sentences become rows, so no row carries the context.
    flat = rows.select(*key, F.posexplode(F.zip_with("_sentences", "_runs", aligned)).alias("sentence_no", "x"))
    return flat.select(*key, F.col("sentence_no").cast("bigint").alias("sentence_no"), "x.*")


_RUN = pa.struct([("run", pa.int32()), ("at", pa.int32())])


def _together(parts: pa.Array, known: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of each piece of a batch that holds up to ``WORDS_AT_ONCE`` words."""
    sizes = pc.list_value_length(known).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    own = pc.list_value_length(parts.flatten()).to_numpy(zero_copy_only=False)
    np.add.at(sizes, owner, own)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + WORDS_AT_ONCE, side="right")))
        yield lo, hi - lo
        lo = hi


def _aligned(parts: pa.Array, known: pa.Array) -> pa.Array:
    """The longest run of each sentence of each row. Words are numbered by Arrow; none becomes a Python object."""
    split = parts.flatten()
    some = [x for x in (known.flatten(), split.flatten()) if len(x)]
    ids = pc.dictionary_encode(pa.concat_arrays(some)).indices.to_numpy() if some else np.zeros(0, dtype=np.int32)
    at_row = _starts(known)
    at_sentence = _starts(split) + at_row[-1]
    first = _starts(parts)
    found = np.empty((2, len(split)), dtype=np.int32)
    for row in range(len(parts)):
        held = ids[at_row[row] : at_row[row + 1]]
        for k in range(first[row], first[row + 1]):
            found[:, k] = longest_run(ids[at_sentence[k] : at_sentence[k + 1]], held)
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in found], fields=list(_RUN)))


def _starts(lists: pa.Array) -> np.ndarray:
    """Where each list begins among all values, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])


def score_alignment(df: DataFrame, key: Sequence[str], answer: str = "answer", context: str = "context_text") -> DataFrame:
    """Share of covered sentences of each answer and its band: ``(*key, covered_share, alignment_evaluator/value)``; 0 without sentences."""
    shares = align_answers(df, key, answer, context).groupBy(*key).agg(F.avg(F.col("covered").cast("double")).alias("covered_share"))
    rows = df.select(*key).join(shares, list(key), "left").withColumn("covered_share", F.coalesce("covered_share", F.lit(0.0)))
    return rows.withColumn("alignment_evaluator/value", grounding_band(F.col("covered_share")))


def judge(
    df: DataFrame,
    make_fn,
    name: str = "grounding_evaluator",
    guidelines: str = GROUNDING_GUIDELINES,
    question: str = "inputs.question",
    answer: str = "answer",
    context: str = "context_text",
) -> DataFrame:
    """Score answers with a caller's model: its reply goes to the column ``<name>/value``."""
    template = "{guidelines}\n\n{context}\n\n{question}\n\n{answer}"
    holes = {
        "guidelines": F.lit(guidelines),
        "context": F.col(context),
        "question": F.col(question),
        "answer": F.col(answer),
    }
    asked = df.withColumn("_judge_prompt", fill_template(template, holes))
    replied = generate(
        asked, make_fn, prompt="_judge_prompt", question="_judge_prompt", answer=f"{name}/value", error=f"{name}/error"
    )
    return replied.drop("_judge_prompt")


METRIC_COLUMNS = {
    "accuracy_evaluator/mean": "accuracy_evaluator/value",
    "accuracy_share/mean": "accuracy_share",
    "relevance_evaluator/mean": "relevance_evaluator/value",
    "grounding_share/mean": "grounding_share",
}


def _means(columns: dict[str, str]) -> list[Column]:
    return [F.round(F.avg(F.col(f"`{c}`")), 6).alias(name) for name, c in columns.items()]


def metrics(df: DataFrame, columns: dict[str, str] = METRIC_COLUMNS) -> DataFrame:
    """One ``(metric, value)`` row per metric: means of the score columns."""
    wide = df.agg(*_means(columns))
    return wide.unpivot([], [f"`{name}`" for name in columns], "metric", "value")


def metrics_by_tag(df: DataFrame, tags: Sequence[str], columns: dict[str, str] = METRIC_COLUMNS) -> DataFrame:
    """Metrics for each value of each tag and over all examples.

    ``tag`` names the tag of a row's group, null for all examples; so an example without the tag (null in the tag's own column)
    is told from the rows that don't look at it.
    """
    tagged = df.select(*[F.col("tags")[t].alias(t) for t in tags], *[F.col(f"`{c}`") for c in columns.values()])
    sets = [[F.col(t)] for t in tags] + [[]]
    of = F.coalesce(*[F.when(F.grouping(t) == 0, F.lit(t)) for t in tags]).alias("tag")
    return tagged.groupingSets(sets, *tags).agg(of, F.count("*").cast("bigint").alias("examples"), *_means(columns))


def _key(c: Column, dtype: T.DataType, name: str) -> tuple[Column, T.DataType] | None:
    """Value and type under a key of a struct or map column, None where the type cannot have the key."""
    if isinstance(dtype, T.StructType):
        return (c[name], dtype[name].dataType) if name in dtype.names else None
    if isinstance(dtype, T.MapType):
        return F.try_element_at(c, F.lit(name)), dtype.valueType
    return None


def _text(c: Column, dtype: T.DataType) -> Column:
    return F.to_json(c) if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)) else c.cast("string")


def _is_dict(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.MapType))


def _inner(c: Column, dtype: T.DataType, names: Sequence[str]) -> Column:
    """First non-empty value among the names of a dict, its string form if it is no dict."""
    if not _is_dict(dtype):
        return _text(c, dtype)
    found = [f for f in (_key(c, dtype, n) for n in names) if f]
    return first_truthy(*[_text(*f) for f in found], F.lit(""))


def _extract(df: DataFrame, outer: str, inner: str, plain: str, names: Sequence[str], direct: Sequence[str]) -> Column:
    if outer in df.columns:
        dtype = df.schema[outer].dataType
        result = None
        nested = _key(F.col(outer), dtype, inner)
        choices = [(nested[0], _inner(*nested, names))] if nested else []
        for name in direct:
            value = _key(F.col(outer), dtype, name)
            if value:
                choices.append((value[0], _text(*value)))
        for present, value in choices:
            result = F.when(present.isNotNull(), value) if result is None else result.when(present.isNotNull(), value)
        return F.lit(ABSENT) if result is None else result.otherwise(ABSENT)
    if inner in df.columns:
        return _inner(F.col(inner), df.schema[inner].dataType, names)
    if plain in df.columns:
        return F.col(plain)
    return F.lit(ABSENT)


def extract_question(df: DataFrame) -> Column:
    """Question of a result row: column ``request``, else ``inputs``, else ``question``, else absent."""
    return _extract(df, "request", "inputs", "question", ("question", "input"), ("question", "input"))


def extract_answer(df: DataFrame) -> Column:
    """Answer of a result row: column ``response``, else ``outputs``, else ``answer``, else absent."""
    return _extract(df, "response", "outputs", "answer", ("answer",), ("answer", "content"))


def parse_json_layout(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """Turn result columns kept as JSON text into structs, so that the layout rules see their keys."""
    return df.withColumns({c: F.from_json(F.col(c), schema) for c, schema in schemas.items()})


def score_column(columns: Sequence[str], word: str) -> str | None:
    """First column whose lower-cased name has the word and the name ``/value``; else first with the word."""
    named = [c for c in columns if word in c.lower()]
    return next((c for c in named if "/value" in c), named[0] if named else None)


def score_text(df: DataFrame, word: str) -> Column:
    name = score_column(df.columns, word)
    return F.lit(ABSENT) if name is None else F.col(f"`{name}`").cast("string")


def number_rows(df: DataFrame, order: str, number: str = "number", pieces: int | None = None) -> DataFrame:
    """Number rows from 1 in the order of any sortable column (nulls first, ties by a hash of the row), without a global window.

    The input is written once, then dealt into ranges of the column and sorted inside them; a row's place in its range is written
    with it, and the row counts of the earlier ranges (one value a range, broadcast) are added. There are ``pieces`` ranges, or as
    many as Spark's shuffle settings make.
    """
    kept = settle(df, "unnumbered")
    tie, place, range_no, before = (f"_{number}_{x}" for x in ("tie", "place", "range", "before"))
    by = [F.col(f"`{order}`"), F.col(tie)]
    dealt = kept.withColumn(tie, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).repartitionByRange(*([pieces] if pieces else []), *by).sortWithinPartitions(*by)
    placed = settle(dealt.drop(tie).withColumn(place, F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn(range_no, F.shiftright(place, 33))
    sizes = placed.groupBy(range_no).agg(F.count("*").alias("n")).orderBy(range_no).collect()  # one row a range
    starts, at = [], 0
    for r in sizes:
        starts.append((r[0], at))
        at += r["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, f"{range_no} bigint, {before} bigint"))
    inside = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(offsets, range_no).withColumn(number, F.col(before) + inside + 1)
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], number)


def report(df: DataFrame, key: str) -> DataFrame:
    """Numbered per-question report with the question, the shortened answer and the three scores."""
    rows = df.select(
        key,
        extract_question(df).alias("question"),
        truncate_text(extract_answer(df), REPORT_ANSWER_LENGTH).alias("answer"),
        *[score_text(df, w).alias(w) for w in ("accuracy", "relevance", "grounding")],
    )
    return number_rows(rows, key)


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First rows in key order."""
    return df.orderBy(key).limit(n)


def stringify_complex(df: DataFrame) -> DataFrame:
    """Struct, array and map columns as JSON text, other columns unchanged."""
    return df.select(
        *[
            _text(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
            if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def result_table(result_df: DataFrame | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The result frame, else the table ``eval_results_table``, else an error."""
    if result_df is not None:
        return result_df
    if tables and "eval_results_table" in tables:
        return tables["eval_results_table"]
    raise ValueError("no evaluation result table")


def observed(df: DataFrame, name: str = "evaluation") -> tuple[DataFrame, Observation]:
    """Count examples and empty answers while the frame is written, without another pass."""
    observation = Observation(name)
    counted = df.observe(
        observation,
        F.count(F.lit(1)).alias("examples"),
        F.count(F.when(F.col("answer") == "", 1)).alias("empty_answers"),
    )
    return counted, observation
