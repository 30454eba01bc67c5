"""Base against tuned models: sparsity, rank and overlap together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tunelens.functions.vectors import UPDATE_THRESHOLD
from tunelens.operators.checkpoints import (
    REPORTED_PATTERNS,
    overall_sparsity,
    param_delta,
    select_tensors,
    update_overlap,
    update_sparsity,
)
from tunelens.operators.ranks import delta_rank


def checkpoint_report(
    params: DataFrame,
    base: str,
    tuned: Sequence[str],
    threshold: float = UPDATE_THRESHOLD,
    patterns: Sequence[str] = REPORTED_PATTERNS,
) -> dict[str, DataFrame]:
    """``tensors`` (sparsity and rank of the reported ones), ``overall`` and, for
    two or more tuned models, ``overlap``."""
    delta = param_delta(params, base, tuned)
    per_tensor = update_sparsity(delta, threshold)
    ranks = delta_rank(delta, patterns)
    report = {
        "tensors": select_tensors(per_tensor, patterns).join(ranks, ["model", "tensor"]),
        "overall": overall_sparsity(per_tensor),
    }
    if len(tuned) >= 2:
        report["overlap"] = update_overlap(delta, tuned, threshold)
    return report
