"""Global positions without an unpartitioned window over the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelens.session import materialise

# Fixed width: a key is 15 hexadecimal digits, its bucket the first four. So there
# are at most 16**4 buckets, and their table (about 2 MB) always fits a broadcast.
KEY_DIGITS = 15
BUCKET_DIGITS = 4


def hash_key(seed: int, *parts: Column) -> Column:
    """Uniform key, as sortable hexadecimal text, from a seed and what names a row."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.substring(F.md5(text), 1, KEY_DIGITS)


def hash_share(key: Column, probability: float) -> Column:
    """Whether a key is among the first ``probability`` of all keys."""
    if probability >= 1:
        return F.lit(True)
    bound = int(probability * 16**KEY_DIGITS)
    return key < f"{bound:0{KEY_DIGITS}x}"


def hash_position(
    df: DataFrame,
    key: Column,
    ties: Sequence[str],
    name: str = "pos",
    below: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """0-based place of every row in key order; rows need unique ``ties``.

    The first digits of a uniform key are a balanced, ordered bucket, so a place
    is rows in earlier buckets plus rank in the bucket. Counting is one narrow
    pre-aggregated scan; only rows that can still be ``below`` a cap shuffle.
    """
    keyed = df.withColumn("__key", key)
    bucket = F.substring("__key", 1, BUCKET_DIGITS)
    counts = keyed.groupBy(bucket.alias("__bucket")).agg(F.count("*").alias("__rows"))
    every = Window.orderBy("__bucket")
    starts = counts.select(
        "__bucket",
        (F.sum("__rows").over(every.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__rows")).alias("__start"),
        F.sum("__rows").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"),
    )
    # The broadcast side has one row per bucket.
    placed = keyed.withColumn("__bucket", bucket).join(F.broadcast(starts), "__bucket")
    if below is not None:
        placed = placed.filter(F.col("__start") < below)
    inside = Window.partitionBy("__bucket").orderBy("__key", *ties)
    placed = placed.withColumn(name, F.col("__start") + F.row_number().over(inside) - 1)
    if below is not None:
        placed = placed.filter(F.col(name) < below)
    if total:
        placed = placed.withColumn(total, F.col("__total"))
    return placed.drop("__key", "__bucket", "__start", "__total")


def with_position(
    df: DataFrame,
    order_by: Sequence[str],
    name: str = "pos",
    within: Sequence[str] = (),
    key: Sequence[str] = (),
) -> DataFrame:
    """0-based place of every row in sort order, restarting for each ``within`` value.

    One range sort splits even a group that holds most rows; the sorted rows are
    written once, because a second sort may pick other range bounds. Places then
    come from rows per (group, partition), never from a window over a group.
    Where ``key`` names a row (null is a name like others), only key and order columns are sorted and written
    and the place is joined back to the wide rows.
    """
    if key:
        narrow = df.select(*dict.fromkeys([*within, *order_by, *key]))
        named = {c: f"__key{i}" for i, c in enumerate(key)}
        placed = with_position(narrow, order_by, name, within).select(*[F.col(c).alias(k) for c, k in named.items()], name)
        same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(placed[k]) for c, k in named.items()])
        return df.join(placed, same).drop(*named.values())
    ordered = materialise(
        df.orderBy(*within, *order_by).select(
            "*",
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().alias("__row"),
        )
    )
    runs = ordered.groupBy(*within, "__part").agg(F.count("*").alias("__rows"), F.min("__row").alias("__first"))
    earlier = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(within)],
        F.col("__part").alias("__at"),
        "__first",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start"),
    )
    same = ordered["__part"] == starts["__at"]
    for i, c in enumerate(within):
        same = same & ordered[c].eqNullSafe(starts[f"__g{i}"])
    return ordered.join(starts, same).select(
        *[ordered[c] for c in df.columns],
        (F.col("__start") + F.col("__row") - F.col("__first")).alias(name),
    )
