"""Reward columns against worked rows and bounds."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tunelens.functions.rewards import REWARDS, trigram_share
from tunelens.functions.text import extract_answer, words
from tunelens.functions.trigrams import text_trigram_share
from tunelens.operators.reward_table import advantage, debug_first, total_reward, with_rewards

L = "".join(f"Sentence number {i} gives a distinct reason {7 * i}. " for i in range(5))

# response, answer, correctness, format, integer, reasoning, repetition; the key is 2
GOLDEN = [
    (L + "#### 2", "2", 2.0, 1.0, 0.5, 0.75, 0.5),
    ("#### 2", "2", 2.0, 1.0, 0.5, -2.0, 0.0),
    (L + "no answer", None, 0.0, 0.0, 0.0, 0.5, 0.5),
    (L + "#### 12", "12", 0.0, 0.3, 0.1, 0.5, 0.5),
    (L + "##### 3", None, 0.0, 1.0, 0.0, 0.5, 0.5),
    (L + "#### 2 because of all that", "2", 2.0, 0.3, 0.5, 0.4, 0.5),
    (L + "#### 1 then #### 4", "4", 0.0, 1.0, 0.5, 0.75, 0.5),
    (L + "####", None, 0.0, 0.3, 0.0, 0.5, 0.5),
    ("yes no " * 40 + "#### 2", "2", 2.0, 1.0, 0.5, 0.35, -0.5),
    (L + "#### 02", "02", 0.0, 0.3, 0.1, 0.5, 0.5),
    ("The first premise rules out option one. " * 3 + "#### 1", "1", 0.0, 1.0, 0.5, 0.55, 0.2),
    ("", None, 0.0, 0.0, 0.0, -2.0, 0.0),
    (L + "#### 2.", "2", 2.0, 0.3, 0.5, 0.5, 0.5),
    ("x " * 60 + "#### 9", "9", 0.0, 1.0, 0.1, 0.35, -0.5),
]


def graded(spark, responses, key=2):
    df = spark.createDataFrame([(i, r, key) for i, r in enumerate(responses)], "i int, response string, correct_option int")
    return total_reward(with_rewards(df)).withColumn("answer", extract_answer(F.col("response"))).orderBy("i")


def test_golden_rows(spark):
    rows = graded(spark, [g[0] for g in GOLDEN]).collect()
    for row, (_, answer, correct, form, integer, reasoning, repetition) in zip(rows, GOLDEN):
        found = (row.correctness, row.format, row.int_answer, row.reasoning_quality, row.no_repetition)
        assert row.answer == answer
        assert found == pytest.approx((correct, form, integer, reasoning, repetition))
        assert row.reward == pytest.approx(sum(found))


def test_missing_response_has_no_reward(spark):
    row = graded(spark, [None]).first()
    assert [row[n] for n in REWARDS] == [None] * len(REWARDS)


@pytest.mark.parametrize("visible, counted", [(10, 0), (11, 1)])
def test_sentence_length_ignores_outer_spaces(spark, visible, counted):
    piece = "  " + "a" + " " * (visible - 2) + "b" + "    "
    text = ("?" + piece + "!").ljust(100, ".")
    assert graded(spark, [text]).first().reasoning_quality == pytest.approx(0.1 * counted)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab 　\n.#1", max_size=120), min_size=1, max_size=8))
def test_counts_agree_with_python(spark, texts):
    """Sentence and trigram counts recomputed from the definition."""
    rows = graded(spark, texts).collect()
    for text, row in zip(texts, rows):
        tokens = text.split()
        grams = [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)]
        share = len(set(grams)) / len(grams) if len(tokens) >= 10 else None
        expected = 0.0 if share is None else 0.5 if share > 0.7 else 0.2 if share > 0.4 else -0.5
        assert row.no_repetition == expected
        if len(text.strip()) < 100:
            assert row.reasoning_quality == -2.0
        assert row.correctness in (0.0, 2.0)
        assert row.format in (0.0, 0.3, 1.0)
        assert row.int_answer in (0.0, 0.1, 0.5)


def test_trigram_share_of_texts(spark):
    """All white space, wide characters that are none, many kinds of words, nulls and long texts."""
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    rng = random.Random(2)
    texts = ["".join(rng.choice(spaces) + rng.choice(["é", "Â", "a", "\u200b", "\ue000", "カ"]) for _ in range(60)) for _ in range(30)]
    texts += ["", " ", "a b", "a b c", None, " ".join(str(i) for i in range(120_000)), "x y " * 50_000]
    texts += [c.join("abcabcabcabd") for c in spaces]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string").repartition(2)
    found = {r.i: r.share for r in df.select("i", text_trigram_share(F.col("c")).alias("share")).collect()}
    for i, text in enumerate(texts):
        tokens = (text or "").split()
        grams = [tuple(tokens[k : k + 3]) for k in range(len(tokens) - 2)]
        assert found[i] == (len(set(grams)) / len(grams) if grams else None)


def test_trigram_share(spark):
    df = spark.createDataFrame([("a b c a b c a b c d",)], "c string")
    share = df.select(trigram_share(words(F.col("c")))).first()[0]
    assert share == pytest.approx(4 / 8)


def test_own_reward_and_weights(spark):
    df = spark.createDataFrame([("#### 2", 2)], "response string, correct_option int")
    chosen = {"a": REWARDS["correctness"], "b": lambda response, key: F.length(response).cast("double")}
    row = total_reward(with_rewards(df, chosen), ["a", "b"], [0.5, 2.0]).first()
    assert row.reward == pytest.approx(0.5 * 2.0 + 2.0 * 6)
    with pytest.raises(ValueError):
        total_reward(df, ["a"], [1.0, 2.0])


def test_advantage(spark):
    rows = [(1, 0, 2.0), (1, 1, 0.0), (1, 2, 1.0), (2, 0, 3.0), (2, 1, 3.0), (3, 0, 5.0)]
    df = spark.createDataFrame(rows, "prompt_id int, sample_id int, reward double")
    got = {(r.prompt_id, r.sample_id): r.advantage for r in advantage(df, eps=0.0001).collect()}
    assert got[(1, 0)] == pytest.approx(1 / 1.0001)
    assert got[(1, 1)] == pytest.approx(-1 / 1.0001)
    assert got[(1, 2)] == pytest.approx(0)
    assert [got[k] for k in ((2, 0), (2, 1), (3, 0))] == [0.0, 0.0, 0.0]


def test_debug_first_shows_the_end_of_the_first_response(spark):
    rows = [(0, 1, "q1", "x" * 400 + "#### 2", 2, 2.0), (0, 0, "q0", "y" * 400 + "#### 3", 2, 0.0)]
    df = spark.createDataFrame(rows, "batch int, pos int, question string, response string, correct_option int, reward double")
    row = debug_first(df).first()
    assert (row.question, row.answer, row.reward) == ("q0", "3", 0.0)
    assert row.response_tail == ("y" * 400 + "#### 3")[-300:]
