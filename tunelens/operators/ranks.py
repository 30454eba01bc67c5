"""Rank of parameter deltas, by tiles.

A matrix is cut in both directions into tiles of at most ``block_cells`` cells. The rank is the number
of singular values above a tolerance, and their squares are the eigenvalues of the product of the
matrix with its transpose over the shorter side. Tiles that share rows (of a tall matrix) or columns
(of a wide one) are joined in pairs, multiplied, and the products summed, in chunks that are as many
as there are summands, so a sum never gathers more than one product. Eigenvalues come from one task
where the shorter side has two strips of tiles at most; longer ones are diagonalised by rounds of
block rotations, in which each pair of strips is rotated by the eigenvectors of its own four tiles and
all other tiles follow by joins with those vectors. Rounds stop when what is left off the diagonal can
move no eigenvalue by a tenth of the squared tolerance.

Products and sums are in double precision. The tolerance is that of float32, max(shape) * 1.2e-7 of
the largest singular value; squared it is at least 1e-14 of the largest eigenvalue, against rounding
of about 1e-16.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelens.functions.common import int_div
from tunelens.operators.checkpoints import REPORTED_PATTERNS, select_tensors
from tunelens.session import materialise

# Cells of a tile: a task holds a dozen tiles at most, 384 MB as doubles.
BLOCK_CELLS = 4_000_000
MAX_SWEEPS = 40
EPSILON = float(np.finfo(np.float32).eps)

_SHAPE = "model string, tensor string, rows long, cols long, strips long"
_KEYS = ("model", "tensor", "rows", "cols", "strips")
_CHUNK = f"{_SHAPE}, low long, high long, chunk long, first long, width long, values array<double>"
_TILE = f"{_SHAPE}, j long, k long, height long, width long, values array<double>"
_TURN = f"{_SHAPE}, pair long, j long, height long, width long, values array<double>"
_RANK = "model string, tensor string, rank int, max_rank int"


def _table(schema: str, key: dict, rows: list[tuple]) -> pa.Table:
    """Rows that share the values of ``key``; the last column holds arrays of doubles."""
    names = [c.split()[0] for c in schema.split(", ")]
    own = [n for n in names if n not in key]
    kinds = [pa.string() if c.endswith(" string") else pa.int64() for c in schema.split(", ")]
    columns = []
    for name, kind in zip(names, kinds, strict=True):
        if name == "values":
            flat = [r[own.index(name)].reshape(-1) for r in rows]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
            data = np.concatenate(flat) if flat else np.zeros(0)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(data)))
        elif name in key:
            columns.append(pa.array([key[name]] * len(rows), kind))
        else:
            columns.append(pa.array([r[own.index(name)] for r in rows], kind))
    return pa.Table.from_arrays(columns, names=names)


def _first(table: pa.Table, names: Sequence[str]) -> dict:
    return {n: table.column(n)[0].as_py() for n in names}


def _lists(table: pa.Table, name: str = "values") -> list[np.ndarray]:
    """The arrays of a list column, without a copy of each number as an object."""
    column = table.column(name).combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _product(table: pa.Table) -> pa.Table:
    """One block's share of the product of two strips, cut into chunks of rows."""
    key = _first(table, (*_KEYS, "low", "high"))
    blocks = table.column("blocks")[0].as_py()
    is_wide = key["cols"] > key["rows"]
    strip, at, offset = (table.column(c).to_numpy() for c in ("strip", "at", "start"))
    values = _lists(table)

    def tile(which: int) -> np.ndarray:
        mine = np.flatnonzero(strip == which)
        mine = mine[np.lexsort((offset[mine], at[mine]))]
        # A row may have come in several records.
        matrix = np.concatenate([values[i] for i in mine]).reshape(len(np.unique(at[mine])), -1)
        return matrix.T if is_wide else matrix

    left = tile(key["low"])
    with np.errstate(all="ignore"):
        found = left.T @ (left if key["low"] == key["high"] else tile(key["high"]))
    height = -(-len(found) // blocks)
    rows = [(c, start, found.shape[1], found[start : start + height]) for c, start in enumerate(range(0, len(found), height))]
    return _table(_CHUNK, key, rows)


def _summed(table: pa.Table) -> pa.Table:
    key = _first(table, (*_KEYS, "low", "high", "chunk", "first", "width"))
    total = np.zeros(1)
    for part in _lists(table):
        total = total + part
    return _table(_CHUNK, key, [(total,)])


def _products(cut: DataFrame) -> DataFrame:
    """Summed chunks of the product of every pair of strips."""
    # A strip's rows meet those of every other strip in the same block.
    paired = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1))).select(
        *_KEYS, "block", "blocks", F.least("strip", "other").alias("low"), F.greatest("strip", "other").alias("high"),
        "strip", "at", "start", "values",
    )
    shares = paired.groupBy(*_KEYS, "block", "low", "high").applyInArrow(_product, _CHUNK)
    return shares.groupBy(*_KEYS, "low", "high", "chunk").applyInArrow(_summed, _CHUNK)


def _assembled(table: pa.Table) -> np.ndarray:
    """Chunks of one pair of strips as their product."""
    order = np.argsort(table.column("first").to_numpy(), kind="stable")
    parts = _lists(table)
    return np.concatenate([parts[i] for i in order]).reshape(-1, table.column("width")[0].as_py())


def _count(key: dict, eigenvalues: np.ndarray) -> pa.Table:
    """The rank that eigenvalues tell; null where they are not finite."""
    rank = None
    if np.isfinite(eigenvalues).all():
        tolerance = max(key["rows"], key["cols"]) * EPSILON
        rank = int((eigenvalues > max(eigenvalues.max(initial=0.0), 0.0) * tolerance**2).sum())
    return pa.table(
        {
            "model": [key["model"]],
            "tensor": [key["tensor"]],
            "rank": pa.array([rank], pa.int32()),
            "max_rank": pa.array([min(key["rows"], key["cols"])], pa.int32()),
        }
    )


def _small_rank(table: pa.Table) -> pa.Table:
    """Rank of a matrix with one or two strips."""
    key = _first(table, _KEYS)
    low, high = (table.column(c).to_numpy() for c in ("low", "high"))
    part = lambda a, b: _assembled(table.filter(pa.array((low == a) & (high == b))))
    whole = part(0, 0)
    if key["strips"] == 2:
        across = part(0, 1)
        whole = np.block([[whole, across], [across.T, part(1, 1)]])
    if not np.isfinite(whole).all():
        return _count(key, np.array([np.nan]))
    return _count(key, np.linalg.eigvalsh(whole))


def _tiles(table: pa.Table) -> pa.Table:
    """The tile of two strips, and the one across the diagonal."""
    key = _first(table, _KEYS)
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    matrix = _assembled(table)
    rows = [(low, high, *matrix.shape, matrix)]
    if low != high:
        rows.append((high, low, *matrix.T.shape, matrix.T))
    return _table(_TILE, key, rows)


def _pair(strip: Column, turn: int) -> Column:
    """The smaller strip of the pair a strip is in; every two strips meet once in a sweep."""
    players = F.col("strips") + F.col("strips") % 2  # an odd one out stays alone
    ring = players - 1
    turned = F.lit(turn) % ring
    other = F.when(strip == ring, turned).when(strip == turned, ring).otherwise(F.pmod(2 * turned - strip, ring))
    return F.least(strip, F.when(other < F.col("strips"), other).otherwise(strip))


def _matrices(table: pa.Table) -> list[tuple[int, int, np.ndarray]]:
    shape = zip(table.column("height").to_pylist(), table.column("width").to_pylist(), strict=True)
    names = table.column_names
    return [
        (j, k, v.reshape(h, w))
        for j, k, (h, w), v in zip(
            table.column("j").to_pylist(),
            table.column("k").to_pylist() if "k" in names else table.column("j").to_pylist(),
            shape,
            _lists(table),
            strict=True,
        )
    ]


def _block_of(parts: dict[tuple[int, int], np.ndarray], left: list[int], right: list[int]) -> np.ndarray:
    return np.block([[parts[j, k] for k in right] for j in left])


def _vectors(table: pa.Table) -> pa.Table:
    """Eigenvectors of a pair's own tiles, by strips of rows."""
    key = _first(table, (*_KEYS, "pair"))
    parts = {(j, k): m for j, k, m in _matrices(table)}
    strips = sorted({j for j, _ in parts})
    sizes = [parts[j, j].shape[0] for j in strips]
    vectors = np.linalg.eigh(_block_of(parts, strips, strips))[1]
    cuts = np.split(vectors, np.cumsum(sizes)[:-1])
    return _table(_TURN, key, [(j, *v.shape, v) for j, v in zip(strips, cuts, strict=True)])


def _turned(table: pa.Table) -> pa.Table:
    """The tiles of two pairs of strips between the eigenvectors of both."""
    key = _first(table, _KEYS)
    side = table.column("side").to_numpy()
    parts = {(j, k): m for j, k, m in _matrices(table.filter(pa.array(side == 0)))}
    left, right = sorted({j for j, _ in parts}), sorted({k for _, k in parts})
    sizes = [[parts[j, right[0]].shape[0] for j in left], [parts[left[0], k].shape[1] for k in right]]
    vectors = []
    for which, strips in ((1, left), (2, right)):
        own = {j: m for j, _, m in _matrices(table.filter(pa.array(side == which)))}
        vectors.append(np.concatenate([own[j] for j in strips]))
    found = vectors[0].T @ _block_of(parts, left, right) @ vectors[1]
    rows = []
    for j, band in zip(left, np.split(found, np.cumsum(sizes[0])[:-1]), strict=True):
        for k, m in zip(right, np.split(band, np.cumsum(sizes[1])[:-1], axis=1), strict=True):
            rows.append((j, k, *m.shape, m))
    return _table(_TILE, key, rows)


def _rotated(tiles: DataFrame, turn: int) -> DataFrame:
    """One round: every pair of strips is diagonalised, all other tiles follow."""
    placed = tiles.withColumn("p", _pair(F.col("j"), turn)).withColumn("q", _pair(F.col("k"), turn))
    own = placed.filter("p = q").withColumn("pair", F.col("p")).drop("p", "q")
    vectors = materialise(own.groupBy(*_KEYS, "pair").applyInArrow(_vectors, _TURN))
    shape = ["j", "k", "height", "width", "values"]
    everywhere = vectors.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1)))
    everywhere = everywhere.filter(_pair(F.col("x"), turn) == F.col("x")).withColumn("k", F.col("j"))
    left = everywhere.select(*_KEYS, F.col("pair").alias("p"), F.col("x").alias("q"), F.lit(1).alias("side"), *shape)
    right = everywhere.select(*_KEYS, F.col("x").alias("p"), F.col("pair").alias("q"), F.lit(2).alias("side"), *shape)
    rows = placed.select(*_KEYS, "p", "q", F.lit(0).alias("side"), *shape).unionByName(left).unionByName(right)
    return materialise(rows.groupBy(*_KEYS, "p", "q").applyInArrow(_turned, _TILE))


def _remainder(table: pa.Table) -> pa.Table:
    """Diagonal of a tile, and the squares of all other cells summed."""
    rows = []
    for j, k, m in _matrices(table):
        diagonal = np.diagonal(m) if j == k else np.zeros(0)
        rows.append((j, float((m * m).sum() - (diagonal * diagonal).sum()), diagonal.copy()))
    key = _first(table, _KEYS)
    found = _table(f"{_SHAPE}, j long, values array<double>", key, [(j, d) for j, _, d in rows])
    return found.append_column("rest", pa.array([max(r, 0.0) for _, r, _ in rows]))


def _large_ranks(products: DataFrame, sweeps: int) -> DataFrame:
    """Ranks of matrices with more than two strips, by rounds of block rotations."""
    tiles = materialise(products.groupBy(*_KEYS, "low", "high").applyInArrow(_tiles, _TILE))
    broken = tiles.filter(F.exists("values", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).select("model", "tensor")
    broken = materialise(broken.distinct())
    shapes = tiles.join(broken, ["model", "tensor"], "left_semi").select(*_KEYS).distinct()
    none = shapes.select(
        "model", "tensor", F.lit(None).cast("int").alias("rank"), F.least("rows", "cols").cast("int").alias("max_rank")
    )
    tiles = tiles.join(broken, ["model", "tensor"], "left_anti")
    most = tiles.agg(F.max("strips")).first()[0] or 0
    rest = f"{_SHAPE}, j long, values array<double>, rest double"
    for sweep in range(sweeps + 1):
        left = materialise(tiles.groupBy(*_KEYS, "j", "k").applyInArrow(_remainder, rest))
        top = F.max(F.coalesce(F.array_max("values"), F.lit(0.0)))
        per = left.groupBy(*_KEYS).agg(F.sqrt(F.sum("rest")).alias("off"), top.alias("top"))
        allowed = (F.col("top") + F.col("off")) * F.pow(F.greatest("rows", "cols") * EPSILON, F.lit(2.0)) / 10
        if per.filter(F.col("off") > allowed).isEmpty():
            break
        if sweep == sweeps:
            raise RuntimeError("the rotations did not converge")
        for turn in range(most + most % 2 - 1):
            tiles = _rotated(tiles, turn)

    def rank(table: pa.Table) -> pa.Table:
        return _count(_first(table, _KEYS), np.concatenate(_lists(table)))

    return left.groupBy(*_KEYS).applyInArrow(rank, _RANK).unionByName(none)


def delta_rank(
    delta: DataFrame,
    patterns: Sequence[str] = REPORTED_PATTERNS,
    block_cells: int = BLOCK_CELLS,
    largest_side: int | None = None,
    sweeps: int = MAX_SWEEPS,
) -> DataFrame:
    """Rank of every two-dimensional delta among the selected tensors; -1 for other shapes.

    A task holds a dozen tiles of ``block_cells`` cells at most, whatever the shape. The shorter side
    of a matrix may have up to two strips of tiles, 2 * sqrt(block_cells) entries; a longer one fails
    unless ``largest_side`` names the longest that occurs, since the rounds for those are run while the
    plan is made. Otherwise nothing runs before the result is used. Null where a delta is not finite.
    """
    chosen = select_tensors(delta, patterns)
    shape = F.col("shape")
    flat = chosen.filter(F.size(shape) == 2).withColumns(
        {"rows": shape[0].cast("long"), "cols": shape[1].cast("long"), "at_row": F.col("row_idx").cast("long")}
    )
    side = max(isqrt(block_cells), 1)
    short, long = F.least("rows", "cols"), F.greatest("rows", "cols")
    strips = int_div(short + side - 1, side)
    flat = flat.withColumn("strips", strips).withColumn("strip_width", int_div(short + F.col("strips") - 1, F.col("strips")))
    height = F.greatest(int_div(F.lit(block_cells), F.col("strip_width")), F.lit(1).cast("long"))
    flat = flat.withColumn("block_height", height).withColumn("blocks", int_div(long + height - 1, height))
    is_wide = F.col("cols") > F.col("rows")
    # A row of a tall matrix lies in one block and goes through all strips; of a wide one the reverse.
    step = F.when(is_wide, F.col("block_height")).otherwise(F.col("strip_width"))
    # A record's pieces end where tiles do; it may be a block of a row itself.
    begin = (F.col("start") if "start" in delta.columns else F.lit(0)).cast("long")
    flat = flat.withColumns({"step": step, "begin": begin, "end": begin + F.size("delta")}).filter("end > begin")
    cuts = F.sequence(int_div(F.col("begin"), F.col("step")), int_div(F.col("end") - 1, F.col("step")))
    cut = flat.select("*", F.explode(cuts).alias("cut")).withColumns(
        {"start": F.greatest("begin", F.col("cut") * F.col("step")), "stop": F.least("end", (F.col("cut") + 1) * F.col("step"))}
    )
    cut = cut.select(
        *_KEYS,
        int_div(F.when(is_wide, F.col("start")).otherwise(F.col("at_row")), F.col("block_height")).alias("block"),
        "blocks",
        int_div(F.when(is_wide, F.col("at_row")).otherwise(F.col("start")), F.col("strip_width")).alias("strip"),
        F.col("at_row").alias("at"),
        "start",
        F.slice(
            "delta", (F.col("start") - F.col("begin") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")
        ).cast("array<double>").alias("values"),
    )
    other = (
        chosen.filter(F.size(shape) != 2)
        .select("model", "tensor")
        .distinct()
        .select("model", "tensor", F.lit(-1).alias("rank"), F.lit(None).cast("int").alias("max_rank"))
    )
    if largest_side is None or largest_side <= 2 * side:
        large = F.raise_error(F.concat(F.lit("name largest_side: tiles are too small for "), F.col("tensor")))
        cut = cut.withColumn("strips", F.when(F.col("strips") <= 2, F.col("strips")).otherwise(large.cast("long")))
        return _products(cut).groupBy(*_KEYS).applyInArrow(_small_rank, _RANK).unionByName(other)
    products = materialise(_products(cut))
    small = products.filter("strips <= 2").groupBy(*_KEYS).applyInArrow(_small_rank, _RANK)
    return small.unionByName(_large_ranks(products.filter("strips > 2"), sweeps)).unionByName(other)
