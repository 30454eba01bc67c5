"""Connected components of a link table by random contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.session import materialise

# A rest of at most so many links, 16 bytes each, is united by one task.
REST_LINKS = 500_000


def unite(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id of the links and the smallest id it reaches."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        while (after[after] != after).any():
            after = after[after]
        after = after[label]
        if (after == label).all():
            return ids, ids[label]
        label = after


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    ids, roots = unite(np.concatenate(a), np.concatenate(b))
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], names=["from", "to"])


def components(links: DataFrame, rest_links: int = REST_LINKS) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); component is the smallest id reachable.

    While there are more than ``rest_links`` links, a round gives every node the neighbour (or
    itself) with the smallest random rank and merges it into that one, which leaves at most about
    half of the nodes; so rounds grow with the log of their number, for long chains too. Neighbours
    are summed up before the shuffle and hubs meet only one-row sides in joins. Each round is a
    table in the shared folder.
    """
    edges = links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).filter(
        "u is not null and v is not null"
    )
    left = materialise(edges)
    moves: list[DataFrame] = []
    while left.count() > rest_links:
        seed = len(moves)
        both = left.union(left.select("v", "u"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("rank"), c.alias("id"))  # noqa: B023, E731
        best = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("best"))
        move = materialise(best.select(F.col("u").alias("from"), F.least("best", rank(F.col("u")))["id"].alias("to")))
        moves.append(move)
        one = left.join(move, left["u"] == move["from"]).select(F.col("to").alias("u"), "v")
        two = one.join(move, one["v"] == move["from"]).select("u", F.col("to").alias("v"))
        kept = two.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        left = materialise(kept.distinct())
    last = left.coalesce(1).mapInArrow(_unite, "from long, to long")
    if not moves:
        return materialise(last.select(F.col("from").alias("id"), F.col("to").alias("component")))
    roots = moves[0].select(F.col("from").alias("id"), F.col("to").alias("root"))
    for move in [*moves[1:], materialise(last)]:
        roots = roots.join(move, roots["root"] == move["from"], "left").select(
            "id", F.coalesce("to", "root").alias("root")
        )
    roots = materialise(roots)
    smallest = roots.groupBy("root").agg(F.min("id").alias("component"))
    return roots.join(smallest, "root").select("id", "component")
