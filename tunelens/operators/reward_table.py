"""Reward columns over a completions table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelens.functions.rewards import REWARDS, RewardFn
from tunelens.functions.text import extract_answer, tail
from tunelens.session import materialise

# Characters shown by the debug row, and the usual advantage epsilon.
DEBUG_RESPONSE_CHARS = 300
ADVANTAGE_EPS = 1e-4


def with_rewards(
    df: DataFrame,
    rewards: Mapping[str, RewardFn] = REWARDS,
    response: str = "response",
    key: str = "correct_option",
) -> DataFrame:
    """One double column per named reward, all in a single projection."""
    return df.withColumns({name: fn(F.col(response), F.col(key)) for name, fn in rewards.items()})


def total_reward(
    df: DataFrame,
    names: Sequence[str] = tuple(REWARDS),
    weights: Sequence[float] | None = None,
) -> DataFrame:
    """Weighted sum of reward columns as ``reward``; equal weights unless given."""
    weights = weights or [1.0] * len(names)
    if len(weights) != len(names):
        raise ValueError("one weight per reward is needed")
    terms: list[Column] = [F.col(n) * w for n, w in zip(names, weights)]
    return df.withColumn("reward", reduce(lambda a, b: a + b, terms))


def debug_first(
    df: DataFrame,
    batch: str = "batch",
    pos: str = "pos",
    question: str = "question",
    response: str = "response",
    key: str = "correct_option",
    reward: str = "reward",
) -> DataFrame:
    """What the first row of each batch looked like.

    Rows shrink to the shown fields first and combine before the shuffle.
    """
    shown = F.struct(
        F.col(question).alias("question"),
        F.col(key).alias("key"),
        tail(F.col(response), DEBUG_RESPONSE_CHARS).alias("response_tail"),
        extract_answer(F.col(response)).alias("answer"),
        F.col(reward).alias("reward"),
    )
    return df.groupBy(batch).agg(F.min_by(shown, F.col(pos)).alias("first")).select(batch, "first.*")


def advantage(
    df: DataFrame,
    group: Sequence[str] = ("prompt_id",),
    reward: str = "reward",
    eps: float = ADVANTAGE_EPS,
) -> DataFrame:
    """Reward minus its group's mean, over its group's sample deviation plus ``eps``.

    Group statistics are aggregated map-side and joined back instead of windowed:
    a window puts a whole group in one task, while a skewed join can be split.
    The statistics, one row per group, are stored first, because a join above an
    aggregate that shares its shuffle is not split. Rows are read twice, so grade
    texts into a narrow table first. Rows without a group are one group.
    """
    stats = materialise(
        df.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)]).agg(
            F.avg(reward).alias("__mean"),
            F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("__std"),
        )
    )
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(stats[f"__g{i}"]) for i, c in enumerate(group)])
    scaled = (F.col(reward) - F.col("__mean")) / (F.col("__std") + eps)
    return df.join(stats, same).withColumn("advantage", scaled).drop(*stats.columns)
