"""Text expressions against worked examples and Python's own string rules."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tunelens.functions import text as X

SPACES = [c for c in map(chr, range(0x110000)) if c.isspace()]


def evaluate(spark, values, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def one(spark, values, column):
    return [r[0] for r in evaluate(spark, values, column)]


@pytest.mark.parametrize(
    "line, sentence, option",
    [
        ("A.The cat sat.", "A. The cat sat.", "The cat sat."),
        ("A.3 people came.", "A.3 people came.", " people came."),
        ("All cats.", "All cats.", " cats."),
        ("Is it, so?", "Is it, so?", "Is it, so?"),
        ("Pi is 3.14 today", "Pi is 3.14 today.", "Pi is 3.14 today."),
        ("It\\'s  fine...", "It's fine.", "It's fine."),
        ("U.S. law.", "U. S. law.", "U. S. law."),
        ("", ".", "."),
        ("b\r\n", "b.", "b."),
        ("Is it so?", "Is it so?", "Is it so?"),
        ("Stop!", "Stop!", "Stop!"),
        ("a.. 5", "a. 5.", "a. 5."),
        ("...5.6.", "5.6.", "5.6."),
        ("x.一y", "x.一y.", "x.一y."),
        ("x.²y", "x.²y.", "x.²y."),
        ("x.二y.z", "x.二y. z.", "x.二y. z."),
    ],
)
def test_sentence_and_option(spark, line, sentence, option):
    clean = X.normalise_sentence(F.col("c"))
    assert evaluate(spark, [line], clean, X.strip_option(clean)) == [(sentence, option)]


def test_answer_index(spark):
    lines = ["a", "b.", "d", "", "cd", "x", "b"]
    assert one(spark, lines, X.answer_index(F.col("c"))) == [0, 1, 3, 0, 2, -1, 1]
    assert one(spark, ["b\r\n"], X.answer_index(X.normalise_sentence(F.col("c")))) == [1]


def test_answers(spark):
    texts = ["x #### 2", "#####1", "#### 1 then #### 4", "####", "none", "#### 02", "#### ٣", "a####b", "####　7!"]
    expected = ["2", None, "4", None, None, "02", "٣", None, "7"]
    assert one(spark, texts, X.extract_answer(F.col("c"))) == expected


def test_same_number(spark):
    digits = ["2", "02", "002", "12", "٢", "00000000000000000000000000000000002", "99999999999999999999999999", "0"]
    expected = [True, True, True, False, True, True, False, False]
    assert one(spark, digits, X.same_number(F.col("c"), F.lit(2))) == expected


def test_every_space_is_stripped_and_splits(spark):
    padded = [f"{c}a{c}b{c}" for c in SPACES]
    rows = evaluate(spark, padded, X.strip(F.col("c")), F.size(X.words(F.col("c"))))
    assert rows == [(f"a{c}b", 2) for c in SPACES]


def test_other_format_characters_are_no_spaces(spark):
    padded = [f"{c}a" for c in ("​", "᠎", "﻿", "\x00")]
    assert one(spark, padded, F.length(X.strip(F.col("c")))) == [2] * 4


def test_every_decimal_digit_is_translated(spark):
    digits = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Nd"]
    assert one(spark, digits, X.ascii_digits(F.col("c"))) == [str(unicodedata.decimal(c)) for c in digits]


def test_word_count(spark):
    texts = ["", "  ", "a", " a  b\tc\n", "a　b"]
    assert one(spark, texts, X.word_count(F.col("c"))) == [len(t.split()) for t in texts]


def test_labels(spark):
    assert one(spark, ["A", " b ", "\tD\n"], X.label_to_option(F.col("c"))) == [1, 2, 4]
