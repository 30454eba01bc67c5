"""Small table helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 20


def cut(*keys: str) -> Column:
    """The first FILTER_BITS bits of the keys' hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - FILTER_BITS)


def cuts(ids: DataFrame, *keys: str) -> DataFrame:
    """The cut hashes of all keys: at most 2**FILTER_BITS rows, whatever the number of keys."""
    return ids.select(cut(*keys).alias("__cut")).distinct()


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids``, shuffling few others.

    The broadcast side has at most 2**FILTER_BITS longs whatever the number of ids; it drops most
    other rows before the exact semi-join.
    """
    seen = F.broadcast(cuts(ids, key))
    likely = rows.withColumn("__cut", cut(key)).join(seen, "__cut", "left_semi").drop("__cut")
    return likely.join(ids.select(key), key, "left_semi")


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``ids``; only those whose hash makes it likely are shuffled."""
    seen = F.broadcast(cuts(ids, key))
    marked = rows.withColumn("__cut", cut(key))
    surely = marked.join(seen, "__cut", "left_anti")
    checked = marked.join(seen, "__cut", "left_semi").join(ids.select(key), key, "left_anti")
    return surely.union(checked.select(*surely.columns)).drop("__cut")
