"""Reward columns: functions of (response, key) that return a double column.

``key`` is the 1-based correct option. A missing response gives a null reward.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tunelens.functions.common import let
from tunelens.functions.divergence import kernel
from tunelens.functions.text import (
    ANSWER_MARK,
    DIGIT_CLASS,
    SPACE_CLASS,
    UNICODE,
    extract_answer,
    last_part,
    marker_parts,
    strip,
)
from tunelens.functions.trigrams import text_trigram_share

RewardFn = Callable[[Column, Column], Column]

# Scores and thresholds of the five rewards.
CORRECT_SCORE = 2.0
FORMAT_EXACT, FORMAT_MARKED = 1.0, 0.3
VALID_OPTIONS = ("1", "2", "3", "4")
INTEGER_VALID, INTEGER_OTHER = 0.5, 0.1
SENTENCE_BREAKS = r".!?\n"
SENTENCE_MIN_CHARS = 10
SENTENCE_SCORES = ((5, 0.5), (3, 0.3), (1, 0.1))
TRAILING_DIGIT_BONUS, TRAILING_TEXT_PENALTY, TRAILING_MAX_CHARS = 0.25, 0.1, 10
SHORT_RESPONSE_CHARS, SHORT_RESPONSE_SCORE = 100, -2.0
REPETITION_MIN_WORDS = 10
REPETITION_SCORES = ((0.7, 0.5), (0.4, 0.2))
REPETITION_PENALTY = -0.5

# A stretch between breaks that, without outer spaces, is longer than the
# minimum: from its first visible character greedily to its last. Counting
# matches gives the number of such stretches without cutting the text up.
LONG_SENTENCE = (
    rf"{UNICODE}[^{SENTENCE_BREAKS}{SPACE_CLASS}][^{SENTENCE_BREAKS}]{{{SENTENCE_MIN_CHARS},}}(?<![{SPACE_CLASS}])"
)


def _present(response: Column, score: Column) -> Column:
    return F.when(response.isNotNull(), score)


def correctness(response: Column, key: Column) -> Column:
    """String comparison: ``02`` is not ``2`` here."""
    hit = F.coalesce(extract_answer(response) == key.cast("string"), F.lit(False))
    return _present(response, F.when(hit, F.lit(CORRECT_SCORE)).otherwise(0.0))


def format_reward(response: Column, key: Column | None = None) -> Column:
    exact = F.rlike(strip(response), F.lit(rf"{UNICODE}{ANSWER_MARK}[{SPACE_CLASS}]*{DIGIT_CLASS}\z"))
    score = (
        F.when(exact, F.lit(FORMAT_EXACT))
        .when(F.contains(response, F.lit(ANSWER_MARK)), FORMAT_MARKED)
        .otherwise(0.0)
    )
    return _present(response, score)


def int_answer(response: Column, key: Column | None = None) -> Column:
    answer = extract_answer(response)
    score = (
        F.when(answer.isin(*VALID_OPTIONS), F.lit(INTEGER_VALID))
        .when(answer.isNotNull(), INTEGER_OTHER)
        .otherwise(0.0)
    )
    return _present(response, score)


def _tiered(value: Column, tiers, default: float, exclusive: bool = False) -> Column:
    """Score of the first bound that ``value`` reaches (passes, when exclusive)."""

    def graded(bound_value: Column) -> Column:
        column = None
        for bound, score in tiers:
            test = bound_value > bound if exclusive else bound_value >= bound
            column = F.when(test, F.lit(score)) if column is None else column.when(test, score)
        return column.otherwise(default)

    return let(value, graded)


def reasoning_quality(response: Column, key: Column | None = None) -> Column:
    reasoning = strip(F.element_at(marker_parts(response), 1))
    sentences = F.regexp_count(reasoning, F.lit(LONG_SENTENCE))
    trailing = last_part(response)
    adjustment = (
        F.when(~F.contains(response, F.lit(ANSWER_MARK)), F.lit(0.0))
        .when(F.rlike(trailing, F.lit(rf"\A{DIGIT_CLASS}\z")), TRAILING_DIGIT_BONUS)
        .when(F.length(trailing) > TRAILING_MAX_CHARS, -TRAILING_TEXT_PENALTY)
        .otherwise(0.0)
    )
    score = (
        F.when(F.length(strip(response)) < SHORT_RESPONSE_CHARS, F.lit(SHORT_RESPONSE_SCORE))
        .otherwise(_tiered(sentences, SENTENCE_SCORES, 0.0) + adjustment)
    )
    return _present(response, score)


def trigram_share(tokens: Column) -> Column:
    """Distinct word trigrams over all trigrams of a list of words; null for fewer than three words.

    Exact: words become ids of their batch, pairs and triples of ids become ids
    in turn, and the triples of a row are counted once.
    """

    def compute(array: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        word = array.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        whole = np.flatnonzero(row[:-2] == row[2:])
        triples, size = word[whole], int(word.max(initial=0)) + 1
        for ahead in (1, 2):
            triples = np.unique(triples * size + word[whole + ahead], return_inverse=True)[1]
        several = int(triples.max(initial=0)) + 1
        distinct = np.unique(row[whole] * several + triples) // several
        share = np.bincount(distinct, minlength=len(lengths)) / np.maximum(lengths - 2, 1)
        return pa.array(share, mask=lengths < 3)

    return kernel("double", compute, tokens)


def no_repetition(response: Column, key: Column | None = None) -> Column:
    share = text_trigram_share(response, REPETITION_MIN_WORDS)
    graded = lambda x: F.when(x.isNull(), F.lit(0.0)).otherwise(
        _tiered(x, REPETITION_SCORES, REPETITION_PENALTY, exclusive=True)
    )
    return _present(response, let(share, graded))


# Named rewards in their configured order; callers may pass their own mapping.
REWARDS: dict[str, RewardFn] = {
    "correctness": correctness,
    "format": format_reward,
    "int_answer": int_answer,
    "no_repetition": no_repetition,
    "reasoning_quality": reasoning_quality,
}
