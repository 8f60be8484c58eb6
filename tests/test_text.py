"""Hand-worked cases for text, chunk and stream-piece functions."""

import pytest
from pyspark.sql import functions as F

from docqa.functions.replies import stream_pieces
from docqa.functions.text import (
    base_name,
    document_chunks,
    first_truthy,
    normalize_newlines,
    section_content,
    section_title,
    split_sections,
    strip,
    truncate_text,
    words,
)
from docqa.functions.vectors import hash_counts


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    "text, sections",
    [
        ("a\n\n\nb\n \nc", ["a\nb", "c"]),
        ("a\n　\nb", ["a", "b"]),
        ("a\n\nb", ["a\nb"]),
        ("", [""]),
        ("a\n\x1c\nb", ["a", "b"]),
    ],
)
def test_sections(spark, text, sections):
    assert one(spark, lambda c: split_sections(normalize_newlines(c)), text) == sections


@pytest.mark.parametrize(
    "section, title",
    [
        ("第１２条（目的）\n本文", "第１２条（目的）"),
        ("第 3 条 支給 \n 本文", "第 3 条 支給"),
        ("前文\n第3条 x", ""),
        ("第一条 漢数字\nx", ""),
        ("第3条", "第3条"),
        ("第3条 a\r\nb", "第3条 a"),
    ],
)
def test_title(spark, section, title):
    assert one(spark, section_title, section) == title


def test_content(spark):
    assert one(spark, lambda c: section_content(c, section_title(c)), "第 3 条 支給 \n 本文 ") == "本文"
    assert one(spark, lambda c: section_content(c, section_title(c)), " 前文 ") == "前文"


def test_chunks_drop_bare_headings_and_format_titles(spark):
    text = "前文\n \n第1条 目的\n本文\n \n第2条\n \n末尾"
    assert one(spark, document_chunks, text) == ["前文", "第1条 目的:\n本文", "末尾"]
    assert one(spark, document_chunks, "a\n\nb") == ["a\nb"]
    assert one(spark, lambda c: document_chunks(c, collapse=False), "a\n\nb") == ["a", "b"]
    assert one(spark, document_chunks, " \n ") == []


@pytest.mark.parametrize("text", ["  x ", "　x ", "\x1fx\n", "x", "", " \n", "a  b", "​x"])
def test_strip_is_python_strip(spark, text):
    assert one(spark, strip, text) == text.strip()


def test_strip_long_inner_blank_run(spark):
    text = "a" + " " * 200_000 + "b"
    assert one(spark, strip, text) == text


@pytest.mark.parametrize(
    "answer, pieces",
    [
        ("短い。", ["短い。"]),
        ("12345678901。x", ["12345678901", "。", "x"]),
        ("1234567890。", ["1234567890。"]),
        ("a\n\nb", ["a\n", "\nb"]),
        ("a。 ", ["a。"]),
        ("", []),
        (" 　 ", []),
        ("！？", ["！", "？"]),
        ("\n\n12345678901", ["\n\n12345678901"]),
    ],
)
def test_stream_pieces(spark, answer, pieces):
    assert one(spark, stream_pieces, answer) == pieces


def test_pieces_rebuild_the_answer(spark):
    answers = ["x" * 30 + "。\n" + "y" * n + "！" * (n % 3) + "\n \n z" for n in range(12)]
    rows = spark.createDataFrame([(a,) for a in answers], "a string").select("a", stream_pieces(F.col("a")).alias("p"))
    for r in rows.collect():
        assert "".join(r.p) == r.a[: len("".join(r.p))]
        assert r.a[len("".join(r.p)) :].strip() == ""
        assert all(p.strip() for p in r.p)


def test_truncate(spark):
    assert one(spark, lambda c: truncate_text(c, 300), "あ" * 300) == "あ" * 300
    assert one(spark, lambda c: truncate_text(c, 300), "あ" * 301) == "あ" * 300 + "..."


def test_small_helpers(spark):
    assert one(spark, base_name, "/a/b/c.pdf") == "c.pdf"
    assert one(spark, base_name, "c.pdf") == "c.pdf"
    assert one(spark, lambda c: first_truthy(c, F.lit("z")), "") == "z"
    assert one(spark, lambda c: first_truthy(c, F.lit("z")), "y") == "y"


def test_hash_counts(spark):
    import hashlib
    import re

    text = "Der Äpfel und der Birne, the THE the 12"
    expected = [0.0] * 16
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        expected[int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 16] += 1
    assert one(spark, lambda c: hash_counts(c, 16), text) == expected
    assert one(spark, lambda c: hash_counts(c, 16), "12 34") == [0.0] * 16


@pytest.mark.parametrize(
    "text, want",
    [
        ("通勤手当はいくら", ["通勤", "勤手", "手当", "はい", "いく", "くら"]),
        ("AI通勤", ["ai", "通勤"]),
        ("第3条の賞与", ["第", "条", "の", "賞与"]),
        ("テレワークー and ｶﾅ", ["テレ", "レワ", "ワー", "ーク", "クー", "and", "ｶﾅ"]),
        ("Plain words, été", ["plain", "words", "été"]),
        ("人々", ["人々"]),
        ("", []),
        ("123 ー", ["ー"]),
    ],
)
def test_words_of_scripts_without_blanks(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(words(F.col("t")).alias("w")).first()
    assert row.w == want


def test_japanese_questions_that_share_a_word_are_near(spark):
    from docqa.functions.vectors import dot, hash_counts
    from docqa.operators.evaluation import words_covered

    a, b, c = "通勤手当はいくらですか。", "今月の通勤手当を教えて", "犬と猫"
    df = spark.createDataFrame([(a, b, c)], "a string, b string, c string")
    vector = lambda x: hash_counts(F.col(x), 4096)
    row = df.select(dot(vector("a"), vector("b")).alias("near"), dot(vector("a"), vector("c")).alias("far"), words_covered(F.col("a"), F.col("b")).alias("share")).first()
    assert row.near > 0 and row.far == 0 and 0 < row.share < 1


def plain_pieces(answer):
    """The rule word for word: parts are added until the held text may be sent."""
    import re

    blank = lambda x: not re.search(r"[^\s\x1c-\x1f]", x)
    held, out = "", []
    for part in re.findall("[^。！？\n]+|[。！？\n]", answer):
        held += part
        if (len(held) > 10 or part in "。！？\n") and not blank(held):
            out.append(held)
            held = ""
    return out + ([held] if not blank(held) else [])


def test_stream_pieces_equal_the_rule_word_for_word(spark):
    import random

    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "bc", " ", "\n", "。", "！", "？", "　", "0123456789", "\x1c", "😀", "é"]) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", stream_pieces(F.col("t")).alias("p")).collect()
    for r in rows:
        assert r.p == plain_pieces(texts[r.i]), repr(texts[r.i])


def test_long_answers_take_time_in_proportion(spark):
    import time

    def took(n):
        for part in ("短い文。", "a" * 40 + "。", " \n"):
            text = part * (n // len(part))
            start = time.perf_counter()
            row = spark.createDataFrame([(text,)], "t string").select(F.size(stream_pieces(F.col("t"))).alias("n")).first()
            yield time.perf_counter() - start, row.n

    list(took(1000))
    small, large = list(took(20_000)), list(took(2_000_000))
    assert all(b[0] < 100 * max(a[0], 0.05) for a, b in zip(small, large)) and large[0][1] == 500_000 and large[2][1] == 0


def test_hash_counts_of_many_rows_match_the_rule(spark):
    """Each word in the bucket of its MD5, a null text as a null vector, rows of several slices and batches."""
    from hashlib import md5

    texts = [None if i % 17 == 0 else " ".join(f"w{'abcdefghij'[(i * j) % 10]}" for j in range(i % 9)) + ("かな漢字 ー x" if i % 5 == 0 else "") for i in range(400)]
    found = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", words(F.col("t")).alias("w"), hash_counts(F.col("t"), 64).alias("v")).collect()
    assert len(found) == 400
    for r in found:
        if r.w is None:
            assert r.v is None and texts[r.i] is None
            continue
        want = [0.0] * 64
        for w in r.w:
            want[int(md5(w.encode()).hexdigest()[:6], 16) % 64] += 1
        assert r.v == want
