"""Per-step roll-ups of reward, length, sampling and timing columns.

All are one or more levels of grouped aggregation, combined map-side first, so
a step or sequence that holds most rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelens.functions.rewards import REWARDS

# The completion limit and the clip range of the logged runs.
COMPLETION_LIMIT = 2048
CLIP_EPS = 0.2


def _long_form(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, metric, value) rows from one row per group: unpivots results, not data."""
    metrics = [c for c in df.columns if c not in by]
    return df.select(*by, *[F.col(c).cast("double") for c in metrics]).unpivot(list(by), metrics, "metric", "value")


def reward_rollup(
    df: DataFrame,
    rewards: Sequence[str] = tuple(REWARDS),
    by: Sequence[str] = ("step",),
    group: str = "prompt_id",
    total: str = "reward",
) -> DataFrame:
    """Mean and sample deviation of each reward and of the total, and the share
    of prompt groups whose rewards are all equal. Rows are read twice, so grade
    texts into a narrow table first."""
    stats: list[Column] = []
    for name in rewards:
        stats += [F.avg(name).alias(f"rewards/{name}/mean"), F.stddev_samp(name).alias(f"rewards/{name}/std")]
    stats += [F.avg(total).alias("reward"), F.stddev_samp(total).alias("reward_std")]
    per_step = _long_form(df.groupBy(*by).agg(*stats), by)
    flat = (
        df.groupBy(*by, group)
        .agg((F.min(total) == F.max(total)).alias("__flat"))
        .groupBy(*by)
        .agg(F.avg(F.col("__flat").cast("double")).alias("frac_reward_zero_std"))
    )
    return per_step.unionByName(_long_form(flat, by))


def length_rollup(
    df: DataFrame,
    limit: int = COMPLETION_LIMIT,
    by: Sequence[str] = ("step",),
    run: Sequence[str] = (),
    tokens: str = "n_tokens",
    prompt_tokens: str = "prompt_tokens",
    finished: str = "finished",
) -> DataFrame:
    """Completion lengths, clipped share, token totals and mean total length.

    ``num_tokens`` runs over the steps of a run: a window over one row per step.
    """
    length = F.col(tokens)
    ended = F.when(F.col(finished), length)
    whole = length + F.col(prompt_tokens)
    clipped = (~F.col(finished)) & (length >= limit)
    per_step = df.groupBy(*run, *by).agg(
        F.avg(length).alias("completions/mean_length"),
        F.min(length).alias("completions/min_length"),
        F.max(length).alias("completions/max_length"),
        F.avg(ended).alias("completions/mean_terminated_length"),
        F.min(ended).alias("completions/min_terminated_length"),
        F.max(ended).alias("completions/max_terminated_length"),
        F.avg(clipped.cast("double")).alias("completions/clipped_ratio"),
        F.sum(whole).alias("__tokens"),
        F.avg(length).alias("response_length"),
        F.avg(whole).alias("total_length"),
    )
    so_far = Window.partitionBy(*run).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    running = per_step.withColumn("num_tokens", F.sum("__tokens").over(so_far)).drop("__tokens")
    return _long_form(running, [*run, *by])


def sampling_rollup(
    tokens: DataFrame,
    eps: float = CLIP_EPS,
    by: Sequence[str] = ("step",),
    worker: str = "worker",
    sequence: str = "seq_id",
) -> DataFrame:
    """Trainer-against-sampler drift per step.

    Token rows fold into sequences, sequences into workers, workers into steps.
    The importance ratio is taken per sequence: exp of the summed difference.
    """
    gap = F.col("logp_train") - F.col("logp_sampler")
    ratio = F.exp(gap)
    low = ((ratio < 1 - eps) & (F.col("advantage") < 0)).cast("long")
    high = ((ratio > 1 + eps) & (F.col("advantage") > 0)).cast("long")
    sequences = tokens.groupBy(*by, worker, sequence).agg(
        F.count("*").alias("n"),
        F.sum(F.abs(gap)).alias("gap_sum"),
        F.max(F.abs(gap)).alias("gap_max"),
        F.exp(F.sum(gap)).alias("ratio"),
        F.sum(low).alias("low"),
        F.sum(high).alias("high"),
        F.sum("entropy").alias("entropy"),
    )
    workers = sequences.groupBy(*by, worker).agg(
        F.sum("n").alias("n"),
        F.sum("gap_sum").alias("gap_sum"),
        F.max("gap_max").alias("gap_max"),
        F.count("*").alias("sequences"),
        F.sum("ratio").alias("ratio_sum"),
        F.min("ratio").alias("ratio_min"),
        F.max("ratio").alias("ratio_max"),
        F.sum("low").alias("low"),
        F.sum("high").alias("high"),
        F.sum("entropy").alias("entropy"),
    )
    n = F.sum("n")
    steps = workers.groupBy(*by).agg(
        (F.sum("gap_sum") / n).alias("sampling/sampling_logp_difference/mean"),
        F.max("gap_max").alias("sampling/sampling_logp_difference/max"),
        F.min("ratio_min").alias("sampling/importance_sampling_ratio/min"),
        (F.sum("ratio_sum") / F.sum("sequences")).alias("sampling/importance_sampling_ratio/mean"),
        F.max("ratio_max").alias("sampling/importance_sampling_ratio/max"),
        (F.sum("low") / n).alias("clip_ratio/low_mean"),
        F.min(F.col("low") / F.col("n")).alias("clip_ratio/low_min"),
        (F.sum("high") / n).alias("clip_ratio/high_mean"),
        F.max(F.col("high") / F.col("n")).alias("clip_ratio/high_max"),
        (F.sum(F.col("low") + F.col("high")) / n).alias("clip_ratio/region_mean"),
        (F.sum("entropy") / n).alias("entropy"),
    )
    return _long_form(steps, by)


def phase_rollup(runs: DataFrame, run: str = "run_id", phase: str = "phase", seconds: str = "seconds") -> DataFrame:
    """Mean and total seconds of each phase of a run, and its share of the run."""
    phases = runs.groupBy(run, phase).agg(
        F.avg(seconds).alias("mean_seconds"),
        F.sum(seconds).alias("total_seconds"),
    )
    whole = F.sum("total_seconds").over(Window.partitionBy(run))
    return phases.withColumn("share", F.when(whole != 0, F.col("total_seconds") / whole).otherwise(0.0))
