"""Scoring of model answers against the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelens.functions.text import extract_answer, same_number, tail

KEYS = ("split", "idx")
# How much of an audited row is shown.
AUDIT_FIRST = 3
AUDIT_QUESTION_CHARS = 200
AUDIT_RESPONSE_CHARS = 300


def align(samples: DataFrame, responses: DataFrame, on: Sequence[str] = KEYS) -> DataFrame:
    """Samples with the response at the same place; ``responded`` is null when there is none."""
    return samples.join(responses.withColumn("responded", F.lit(True)), list(on), "left")


def outcome(answer: Column, correct_option: Column) -> Column:
    """Integer comparison against a 0-based key: ``02`` counts as 2."""
    return (
        F.when(answer.isNull(), F.lit("no_answer"))
        .when(same_number(answer, correct_option + 1), "correct")
        .otherwise("wrong")
    )


def classify(aligned: DataFrame) -> DataFrame:
    """Add ``answer`` and ``outcome``; a sample without a response has neither."""
    answered = aligned if "answer" in aligned.columns else aligned.withColumn("answer", extract_answer(F.col("response")))
    return answered.withColumn("outcome", F.when(F.col("responded"), outcome(F.col("answer"), F.col("correct_option"))))


def answers(responses: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys and short answers only, so that a later join shuffles no response text."""
    return responses.select(*on, extract_answer(F.col("response")).alias("answer"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == o).alias(o) for o in ("correct", "wrong", "no_answer")]


def _with_rates(counts: DataFrame) -> DataFrame:
    rate = F.when(F.col("total") > 0, F.col("correct") / F.col("total") * 100).otherwise(0.0)
    return counts.withColumn("accuracy", rate).withColumn("pct_passed", rate)


def _combine(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add a ``combined`` row per group over the few rows of a scorecard."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "correct", "wrong", "no_answer")]
    combined = counts.groupBy(*by).agg(*sums).withColumn("split", F.lit("combined"))
    return counts.unionByName(combined)


def scorecard(
    samples: DataFrame,
    responses: DataFrame,
    on: Sequence[str] = KEYS,
    combined: bool = False,
    splits: Sequence[str] = (),
) -> DataFrame:
    """One row per split, plus the combined totals on request.

    A sample without a response counts in ``total`` and in no outcome. Named
    ``splits`` have a row even if they are empty.
    """
    scored = classify(align(samples.select(*on, "correct_option"), answers(responses, on), on))
    counts = scored.groupBy("split").agg(F.count("*").alias("total"), *_counts())
    if splits:
        named = F.explode(F.array(*[F.lit(s) for s in splits])).alias("split")
        every = samples.sparkSession.range(1).select(named)
        counts = counts.join(every, "split", "full").fillna(0)
    return _with_rates(_combine(counts, []) if combined else counts)


def compare_models(
    samples: DataFrame,
    responses: DataFrame,
    splits: Sequence[str] | None = None,
    on: Sequence[str] = KEYS,
    combined: bool = False,
) -> DataFrame:
    """The scorecard of every model that responded, each over all samples of the named splits, or of all.

    Outcomes come from one inner join; totals from the samples alone, so no
    model-by-sample grid is built to find missing responses. A split in which a
    model answered nothing, or that has no samples, still has its row.
    """
    asked = samples if splits is None else samples.filter(F.col("split").isin(*splits))
    given = answers(responses, ["model", *on]).withColumn("responded", F.lit(True))
    scored = classify(asked.select(*on, "correct_option").join(given, list(on)))
    outcomes = scored.groupBy("model", "split").agg(*_counts())
    totals = asked.groupBy("split").agg(F.count("*").alias("total"))
    if splits is None:
        every = totals.agg(F.collect_list("split").alias("splits"))
    else:
        every = samples.sparkSession.range(1).select(F.array(*[F.lit(s) for s in splits]).alias("splits"))
    # The names of the splits are one row, read as a scalar.
    models = responses.select("model").distinct().withColumn("splits", every.scalar())
    counts = (
        models.select("model", F.explode("splits").alias("split"))
        .join(totals, "split", "left")
        .join(outcomes, ["model", "split"], "left")
        .select("model", "split", "total", "correct", "wrong", "no_answer")
        .fillna(0)
    )
    return _with_rates(_combine(counts, ["model"]) if combined else counts)


def audit_rows(
    samples: DataFrame,
    responses: DataFrame,
    on: Sequence[str] = KEYS,
    first: int = AUDIT_FIRST,
) -> DataFrame:
    """The first rows of each split and every answered-but-wrong one.

    Question and response are cut before the join; only short text is shuffled.
    """
    asked = samples.select(
        *on, "correct_option", F.substring("query", 1, AUDIT_QUESTION_CHARS).alias("question")
    )
    given = responses.select(
        *on,
        extract_answer(F.col("response")).alias("answer"),
        tail(F.col("response"), AUDIT_RESPONSE_CHARS).alias("response_tail"),
        F.lit(True).alias("responded"),
    )
    scored = classify(asked.join(given, list(on)))
    return scored.filter((F.col("idx") < first) | (F.col("outcome") == "wrong")).select(
        *on,
        "question",
        (F.col("correct_option") + 1).alias("truth"),
        "answer",
        (F.col("outcome") == "correct").alias("is_correct"),
        "response_tail",
    )
