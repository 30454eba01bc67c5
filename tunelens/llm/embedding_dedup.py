"""Embedding near-duplicates: lattice hashing with E8 and exact cosines.

In each of TABLES tables a unit vector is projected to eight dimensions and decoded to the nearest
point of the E8 lattice, its cell. It is also a visitor in the PROBES neighbouring cells that its
remainder points to. Vectors meet where one owns a cell and the other owns or visits it; every pair
that meets is measured in double precision. At cosine 0.9 a pair meets in one table with a
probability of about 0.6, so about one pair in ten thousand right at the threshold is missed, and
at 0.95 practically none.

Links are counted inside tasks and never listed for a group: a pair that shares a cell as owners is
counted in the first table where it does, and a task returns per vector a count and its root among
the links seen there. Only pairs that are owners of no common cell in any table are returned as
pairs. Cells with many vectors are dealt into pairs of blocks, so no task holds more than about two
blocks of rows. Equal vectors are one node with a multiplicity.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, and so do vectors of different lengths and rows with a null id, whose component is null;
repeated rows are linked; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.llm.components import components
from tunelens.session import materialise

TABLES = 10
PROBES = 4
SCALE = 0.65  # cell size against the projected distances
MIN_COSINE = 0.9
BLOCK_ROWS = 2_048
GROUP_ROWS = 20_000  # rows of small cells handled in one call

CELLS = "node long, copies long, vector array<float>, cells array<long>, owned array<int>"
FOUND = "x long, y long, n long"


def shortest_vectors() -> np.ndarray:
    """The 240 vectors from an E8 point to its neighbours."""
    rows = []
    for i, j in product(range(8), range(8)):
        for a, b in product((1.0, -1.0), (1.0, -1.0)):
            if i < j:
                row = np.zeros(8)
                row[i], row[j] = a, b
                rows.append(row)
    halves = np.array(list(product((0.5, -0.5), repeat=8)))
    return np.concatenate([np.array(rows), halves[(halves < 0).sum(1) % 2 == 0]])


NEIGHBOURS = shortest_vectors()


def nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of an even sum."""
    point = np.rint(x)
    rest = x - point
    row, worst = np.arange(len(x)), np.abs(rest).argmax(1)
    odd = point.sum(1) % 2 != 0
    point[row[odd], worst[odd]] += np.where(rest[row, worst] >= 0, 1.0, -1.0)[odd]
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8: whole coordinates or halves, with an even sum."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    rows = vectors.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))


def _point_codes(table: int, width: int, points: np.ndarray) -> np.ndarray:
    doubled = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    with np.errstate(over="ignore"):
        code = np.full(points.shape[:-1], table * 100_003 + width, np.uint64)
        for k in range(8):
            code = (code ^ doubled[..., k]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
    return code.astype(np.int64)


def lattice_cells(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own cell of every row in each table, and the cells it visits there."""
    n, width = units.shape
    own, visits = [], []
    for table in range(TABLES):
        random = np.random.default_rng([table, width])
        x = units @ (random.standard_normal((width, 8)) * SCALE) + random.random(8)
        point = nearest_e8(x)
        towards = (x - point) @ NEIGHBOURS.T
        chosen = np.argpartition(-towards, PROBES, axis=1)[:, :PROBES]
        own.append(_point_codes(table, width, point))
        visits.append(_point_codes(table, width, point[:, None, :] + NEIGHBOURS[chosen]))
    return np.stack(own, 1), np.stack(visits, 1).reshape(n, -1)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, GROUP_ROWS):
            part = batch.slice(start, GROUP_ROWS)
            lists = part.column(2)
            widths = lists.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                rows = part.filter(pa.array(widths == width))
                vectors = rows.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                own, visits = lattice_cells(unit_rows(vectors))
                cells = np.concatenate([own, visits], 1)
                short = (own ^ (own >> 32)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(1),
                        rows.column(2).cast(pa.list_(pa.float32())),
                        _as_lists(cells, pa.int64()),
                        _as_lists(short, pa.int32()),
                    ],
                    names=["node", "copies", "vector", "cells", "owned"],
                )


def _as_lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1), kind))


def _roots(linked: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each row of a symmetric link matrix."""
    root = node.copy()
    while True:
        lower = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1))
        if (lower == root).all():
            return root
        root = lower


def cell_links(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Counts and roots of owners, and pairs of visitors with owners, for each cell of a group.

    A row (x, y, n) with n >= 0 says that x has n links counted here and is connected with y; one
    with n = -1 is a single link between x and y.
    """
    rows = rows.sort_values(["cell", "low", "high"], ignore_index=True)
    node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
    place, block = rows["place"].to_numpy(), rows["block"].to_numpy()
    units = unit_rows(np.stack(rows["vector"].to_numpy()))
    owned = np.stack(rows["owned"].to_numpy())
    key = rows[["cell", "low", "high"]].to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
        here = np.arange(start, stop)
        owners = here[place[here] < TABLES]
        visitors = here[place[here] >= TABLES]
        if not len(owners) or len(here) < 2:
            continue
        table = int(place[owners[0]])
        across = rows["low"][start] != rows["high"][start]
        apart = lambda a, b: (block[a][:, None] != block[b][None, :]) | (not across)  # noqa: B023, E731
        close = (units[owners] @ units[owners].T >= least) & apart(owners, owners)
        np.fill_diagonal(close, False)
        i, j = np.nonzero(close)
        if len(i):
            root = _roots(close, node[owners])
            first = ~(owned[owners[i], :table] == owned[owners[j], :table]).any(1)
            n = np.bincount(i[first], copies[owners[j[first]]], len(owners)).astype(np.int64)
            some = (n > 0) | (root != node[owners])
            # A row without a count of its own still tells what it is connected with.
            out.append((node[owners[some]], root[some], n[some]))
        if len(visitors):
            close = (units[visitors] @ units[owners].T >= least) & apart(visitors, owners)
            i, j = np.nonzero(close)
            lone = ~(owned[visitors[i]] == owned[owners[j]]).any(1)
            a, b = node[visitors[i[lone]]], node[owners[j[lone]]]
            out.append((np.minimum(a, b), np.maximum(a, b), np.full(len(a), -1, np.int64)))
    x, y, n = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (node[:0],) * 3
    return pd.DataFrame({"x": x, "y": y, "n": n})


def near_vectors(
    embeddings: DataFrame, least: float = MIN_COSINE, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    values = F.col(vector)
    usable = (
        (F.size(F.coalesce(values, F.array().cast(embeddings.schema[vector].dataType))) > 0)
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(values, lambda x: x != 0)
    )
    clean = F.transform(values, lambda x: x + F.lit(0).cast("float"))  # -0 becomes 0
    judged = embeddings.select(
        F.col(key).cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), clean).alias("vector")
    ).withColumns({"key1": F.xxhash64("vector"), "key2": F.xxhash64(F.lit(1), "vector")})
    valid = judged.filter(F.col("vector").isNotNull() & F.col("vec_id").isNotNull())
    nodes = valid.groupBy("key1", "key2").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")
    )
    named = materialise(nodes)
    placed = materialise(named.select("node", "copies", "vector").mapInArrow(_place, CELLS))
    rows = placed.select("node", "copies", "vector", "owned", F.posexplode("cells").alias("place", "cell"))
    sizes = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > 2 * BLOCK_ROWS).select("cell", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"))
    shared = sizes.filter("n > 1").select("cell")
    groups = max(1, placed.count() * TABLES * (1 + PROBES) // GROUP_ROWS)
    blocks = F.coalesce("blocks", F.lit(1)).cast("int")
    dealt = (
        rows.join(shared, "cell", "left_semi")
        .join(large, "cell", "left")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .withColumn("group", F.pmod(F.xxhash64("cell", "low", "high"), F.lit(groups)))
        .withColumn("width", F.size("vector"))  # cells of vectors of different lengths differ, too
        .select("group", "width", "cell", "low", "high", "block", "place", "node", "copies", "vector", "owned")
    )
    found = materialise(
        dealt.groupBy("group", "width").applyInPandas(lambda part: cell_links(part, least), FOUND)
    )
    singles = found.filter("n < 0").select("x", "y").distinct()
    both = singles.union(singles.select("y", "x")).toDF("x", "y")
    weights = named.filter("copies > 1").select(F.col("node").alias("y"), "copies")
    lone = both.join(weights, "y", "left").select("x", F.coalesce("copies", F.lit(1)).alias("n"))
    counts = found.filter("n > 0").select("x", "n").union(lone).groupBy("x").agg(F.sum("n").alias("linked"))
    rooted = components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    told = (
        named.join(counts, named["node"] == counts["x"], "left")
        .join(rooted, named["node"] == rooted["id"], "left")
        .filter((F.col("copies") > 1) | F.col("linked").isNotNull())
        .select(
            "key1",
            "key2",
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    taking_part = F.col("vector").isNotNull() & F.col("vec_id").isNotNull()
    usable_key = F.when(taking_part, F.col("key1")).alias("key1")
    out = judged.select("vec_id", usable_key, "key2").join(told, ["key1", "key2"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
