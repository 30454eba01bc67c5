"""Elementwise expressions over parameter rows (arrays of float32)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An update below the first, a gradient below the second, counts as zero.
UPDATE_THRESHOLD = 1e-5
GRADIENT_THRESHOLD = 1e-6


def row_delta(tuned: Column, base: Column) -> Column:
    return F.zip_with(tuned, base, lambda a, b: a - b)


def is_updated(value: Column, threshold: float) -> Column:
    """Spark sorts NaN above every number, so it has to be ruled out by hand."""
    return (F.abs(value) >= F.lit(threshold).cast("float")) & ~F.isnan(value)


def update_mask(delta: Column, threshold: float = UPDATE_THRESHOLD) -> Column:
    return F.transform(delta, lambda x: is_updated(x, threshold))


def updated_positions(delta: Column, threshold: float = UPDATE_THRESHOLD) -> Column:
    """0-based places of updated entries: far shorter than a mask when updates are sparse."""
    marked = F.transform(delta, lambda x, i: F.when(is_updated(x, threshold), i))
    return F.array_compact(marked)


def count_unchanged(delta: Column, threshold: float = UPDATE_THRESHOLD) -> Column:
    """Entries below the threshold; NaN is neither unchanged nor updated."""
    return F.size(F.filter(delta, lambda x: F.abs(x) < F.lit(threshold).cast("float"))).cast("long")


def count_nan(delta: Column) -> Column:
    return F.size(F.filter(delta, lambda x: F.isnan(x))).cast("long")
