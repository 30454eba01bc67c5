"""Capping, shuffling, batching and blending of prompt tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelens.functions.common import int_div
from tunelens.operators.ordering import hash_key, hash_position, hash_share, with_position

# Fixed value: the seed of the logged runs.
SHUFFLE_SEED = 42


def cap_total(df: DataFrame, n: int, splits: Sequence[str], idx: str = "idx") -> DataFrame:
    """Keep the first ``n`` rows of the splits laid end to end in the given order.

    ``idx`` is the dense place inside a split, so a row's overall place needs
    only the sizes of earlier splits: a table with one row per named split.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split"))
    sizes = (
        df.filter(F.col("split").isin(*splits))
        .groupBy("split")
        .agg(F.count("*").alias("__size"))
        .withColumn("__order", order)
    )
    earlier = Window.orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("split", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"))
    return (
        df.join(F.broadcast(starts), "split")  # one row per named split
        .filter(F.col("__start") + F.col(idx) < n)
        .drop("__start")
    )


def first_n(
    df: DataFrame,
    n: int,
    pos: str | None = None,
    order_by: Sequence[str] = (),
    key: Sequence[str] = (),
) -> DataFrame:
    """The first ``n`` rows.

    With a dense position this is a filter that reaches the scan. Otherwise it is
    a sorted limit, over ``key`` and order alone where a key names a row; each
    task keeps ``n`` narrow rows at most.
    """
    if pos is not None:
        return df.filter(F.col(pos) < n)
    if not key:
        return df.orderBy(*order_by).limit(n)
    narrow = df.select(*dict.fromkeys([*order_by, *key])).orderBy(*order_by).limit(n)
    chosen = narrow.select(*[F.col(c).alias(f"__key{i}") for i, c in enumerate(key)])
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(chosen[f"__key{i}"]) for i, c in enumerate(key)])
    return df.join(chosen, same, "left_semi")


def shuffle_epoch(
    df: DataFrame,
    id_cols: Sequence[str],
    epoch: int = 0,
    batch_size: int = 1,
    seed: int = SHUFFLE_SEED,
    drop_last: bool = True,
) -> DataFrame:
    """Seeded order as a ``pos`` column, without the last incomplete batch."""
    key = hash_key(seed, F.lit(epoch), *[F.col(c) for c in id_cols])
    placed = hash_position(df, key, id_cols, total="__all")
    if drop_last:
        placed = placed.filter(F.col("pos") < F.col("__all") - F.col("__all") % batch_size)
    return placed.drop("__all")


def assign_batches(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """Batch number and place in the batch; the last batch may be short."""
    return df.withColumn("batch", int_div(F.col(pos), size)).withColumn("slot", F.col(pos) % size)


def expand_samples(df: DataFrame, n: int) -> DataFrame:
    """``n`` rows per prompt, numbered by ``sample_id``."""
    return df.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def step_plan(
    df: DataFrame,
    n_samples_per_prompt: int,
    rollout_batch_size: int,
    train_batch_size: int,
    epochs: float,
) -> DataFrame:
    """One row: iterations per epoch, updates per iteration, iterations in all."""
    rows = df.agg(F.count("*").alias("rows"))
    per_epoch = int_div(F.col("rows") * n_samples_per_prompt, rollout_batch_size)
    updates = int_div(F.lit(rollout_batch_size * n_samples_per_prompt), train_batch_size)
    return rows.select(
        "rows",
        per_epoch.alias("iterations_per_epoch"),
        updates.alias("updates_per_iteration"),
        F.ceil(F.lit(epochs) * per_epoch).alias("iterations"),
    )


def blend(
    sources: Sequence[tuple[DataFrame, float | None]],
    id_cols: Sequence[str],
    seed: int = SHUFFLE_SEED,
    cap: int | None = None,
) -> DataFrame:
    """Union of sources, each thinned to its probability, capped in hash order.

    A row stays or goes by the hash of its own id, so the choice does not depend
    on partitioning and a lost executor's rows are chosen again alike. No
    probability keeps a whole source.
    """

    def key(ordinal: Column) -> Column:
        return hash_key(seed, ordinal, *[F.col(c) for c in id_cols])

    kept = []
    for ordinal, (source, probability) in enumerate(sources):
        if probability is not None:
            source = source.filter(hash_share(key(F.lit(ordinal)), probability))
        kept.append(source.withColumn("source_ord", F.lit(ordinal)))
    blended = reduce(lambda left, right: left.unionByName(right), kept)
    if cap is None:
        return blended
    # A second seed keeps the cut from favouring keys that passed the thinning.
    cut = hash_key(seed + 1, F.col("source_ord"), *[F.col(c) for c in id_cols])
    return hash_position(blended, cut, ["source_ord", *id_cols], name="__pos", below=cap).drop("__pos")
