"""Comparison of tuned parameter tables with their base.

A parameter table has one matrix row per record: (model, tensor, shape,
row_idx, values). (tensor, row_idx) is unique per model, so joins on it have no
hot key however large one tensor is. Rows too wide for a record come as several:
a further column ``start`` tells the column a record begins at (``split_rows``),
and belongs to the key. All counts are taken per record and add up.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.functions.common import let
from tunelens.functions.vectors import (
    UPDATE_THRESHOLD,
    count_nan,
    count_unchanged,
    row_delta,
    updated_positions,
)

ROW = ("tensor", "row_idx")
# The tensors reported one by one.
REPORTED_PATTERNS = ("mlp.down_proj.weight", "self_attn.v_proj.weight")


def row_key(df: DataFrame) -> tuple[str, ...]:
    """What names a record within a model."""
    return (*ROW, "start") if "start" in df.columns else ROW


def split_rows(params: DataFrame, width: int, values: str = "values") -> DataFrame:
    """Records of at most ``width`` entries, each with the column it begins at.

    Records that are blocks already are cut further; an empty one stays a record.
    """
    begin = F.col("start") if "start" in params.columns else F.lit(0).cast("long")
    inner = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(width))
    cut = params.select("*", F.explode(inner).alias("__at"))
    return cut.withColumns(
        {"start": begin + F.col("__at"), values: F.slice(values, F.col("__at") + 1, F.lit(width))}
    ).drop("__at")


def param_delta(params: DataFrame, base: str, tuned: Sequence[str]) -> DataFrame:
    """Tuned minus base for rows of tensors both have; a shape mismatch is an error."""
    key = row_key(params)
    original = params.filter(F.col("model") == base).select(
        *key, F.col("shape").alias("__shape"), F.col("values").alias("__base")
    )
    changed = params.filter(F.col("model").isin(*tuned)).select("model", "shape", *key, "values")
    mismatch = F.raise_error(F.concat(F.lit("shape mismatch in "), F.col("tensor"), F.lit(" of "), F.col("model")))
    delta = F.when(F.col("shape") == F.col("__shape"), row_delta(F.col("values"), F.col("__base"))).otherwise(
        mismatch.cast("array<float>")
    )
    places = [c for c in key if c not in ROW]
    return changed.join(original, list(key)).select("model", "tensor", "shape", "row_idx", *places, delta.alias("delta"))


def update_sparsity(delta: DataFrame, threshold: float = UPDATE_THRESHOLD) -> DataFrame:
    """Unchanged entries per model and tensor; counts are taken per row before any shuffle."""
    counted = delta.select(
        "model",
        "tensor",
        F.size("delta").cast("long").alias("size"),
        count_unchanged(F.col("delta"), threshold).alias("unchanged"),
        count_nan(F.col("delta")).alias("nan"),
    )
    return (
        counted.groupBy("model", "tensor")
        .agg(F.sum("size").alias("params"), F.sum("unchanged").alias("unchanged"), F.sum("nan").alias("nan"))
        .withColumn("sparsity", F.when(F.col("params") > 0, F.col("unchanged") / F.col("params")).otherwise(0.0))
    )


def overall_sparsity(per_tensor: DataFrame) -> DataFrame:
    """Share over all common tensors of a model, from the per-tensor counts."""
    totals = per_tensor.groupBy("model").agg(F.sum("params").alias("params"), F.sum("unchanged").alias("unchanged"))
    return totals.withColumn(
        "sparsity", F.when(F.col("params") > 0, F.col("unchanged") / F.col("params")).otherwise(0.0)
    )


def select_tensors(df: DataFrame, patterns: Sequence[str] = REPORTED_PATTERNS) -> DataFrame:
    """Tensors whose name contains any of the patterns; pushes down to the scan."""
    return df.filter(reduce(lambda a, b: a | b, [F.col("tensor").contains(p) for p in patterns]))


def update_overlap(delta: DataFrame, tuned: Sequence[str], threshold: float = UPDATE_THRESHOLD) -> DataFrame:
    """Updated-by-both over updated-by-either for each pair of models.

    The delta rows already sit by (tensor, row_idx), so gathering the models of
    one row (at most one entry per named model) needs no further shuffle. Rows
    carry places of updates, not masks, and are counted before summing.
    """
    if len(tuned) < 2:
        raise ValueError("overlap needs two or more models")
    spark = delta.sparkSession
    names = F.array(*[F.lit(n) for n in tuned])
    key = row_key(delta)
    marked = delta.filter(F.col("model").isin(*tuned)).select(
        *key,
        F.struct(
            F.array_position(names, F.col("model")).alias("ord"),
            updated_positions(F.col("delta"), threshold).alias("at"),
        ).alias("update"),
    )
    per_row = marked.groupBy(*key).agg(F.collect_list("update").alias("updates"))

    def pairs(updates):
        return F.flatten(
            F.transform(
                updates,
                lambda a: F.transform(
                    F.filter(updates, lambda b: b["ord"] > a["ord"]),
                    lambda b: F.struct(
                        a["ord"].alias("a"),
                        b["ord"].alias("b"),
                        F.size(F.array_intersect(a["at"], b["at"])).cast("long").alias("in_both"),
                        (F.size(a["at"]) + F.size(b["at"])).cast("long").alias("sizes"),
                    ),
                ),
            )
        )

    counted = (
        per_row.select(F.explode(let(F.col("updates"), pairs)).alias("p"))
        .groupBy("p.a", "p.b")
        .agg(F.sum("p.in_both").alias("in_both"), F.sum("p.sizes").alias("sizes"))
    )
    # One row per pair of named models, so a pair with nothing in common shows as 0.
    listed = spark.createDataFrame(
        [(i + 1, j + 1, tuned[i], tuned[j]) for i, j in combinations(range(len(tuned)), 2)],
        "a long, b long, model_a string, model_b string",
    )
    both = F.coalesce(F.col("in_both"), F.lit(0))
    either = F.coalesce(F.col("sizes"), F.lit(0)) - both
    return listed.join(counted, ["a", "b"], "left").select(
        "model_a",
        "model_b",
        both.alias("in_both"),
        either.alias("in_either"),
        F.when(either > 0, both / either).otherwise(0.0).alias("overlap"),
    )
