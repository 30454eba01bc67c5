"""Gradient telemetry per step and parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelens.functions.vectors import GRADIENT_THRESHOLD

BY = ("step", "name")


def grad_aggregates(threshold: float = GRADIENT_THRESHOLD) -> list[Column]:
    """L2 norm and share of near-zero entries; both combine map-side."""
    grad = F.col("grad")
    return [
        F.sqrt(F.sum(grad * grad)).alias("grad_norm"),
        F.avg((F.abs(grad) < threshold).cast("double")).alias("grad_sparsity"),
    ]


def grad_metrics(df: DataFrame, by: Sequence[str] = BY, threshold: float = GRADIENT_THRESHOLD) -> DataFrame:
    """One row per (step, parameter); a parameter without gradient is skipped."""
    return df.filter(F.col("grad").isNotNull()).groupBy(*by).agg(*grad_aggregates(threshold))


def grad_norm(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return grad_metrics(df, by).select(*by, "grad_norm")


def grad_sparsity(df: DataFrame, by: Sequence[str] = BY, threshold: float = GRADIENT_THRESHOLD) -> DataFrame:
    return grad_metrics(df, by, threshold).select(*by, "grad_sparsity")


def to_metrics(df: DataFrame) -> DataFrame:
    """(step, metric, value) rows named ``grad_norm/NAME`` and ``grad_sparsity/NAME``."""
    long = df.unpivot(["step", "name"], ["grad_norm", "grad_sparsity"], "kind", "value")
    return long.select("step", F.concat_ws("/", "kind", "name").alias("metric"), "value")
