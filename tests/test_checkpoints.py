"""Parameter comparison against numpy on small matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelens.functions.vectors import update_mask
from tunelens.operators.checkpoints import overall_sparsity, param_delta, split_rows, update_overlap, update_sparsity
from tunelens.operators.ranks import delta_rank
from tunelens.plans.checkpoint_report import checkpoint_report

SCHEMA = "model string, tensor string, shape array<int>, row_idx long, values array<float>"
V, D = "l.0.self_attn.v_proj.weight", "l.0.mlp.down_proj.weight"


def table(spark, models):
    rows = []
    for model, tensors in models.items():
        for name, values in tensors.items():
            array = np.asarray(values, dtype=np.float32)
            flat = array.reshape(1, -1) if array.ndim == 1 else array
            rows += [(model, name, list(array.shape), i, [float(x) for x in r]) for i, r in enumerate(flat)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def models():
    rng = np.random.default_rng(1)
    base = {V: rng.normal(size=(6, 4)), D: rng.normal(size=(3, 7)), "norm": rng.normal(size=5), "only_base": np.ones(3)}
    base = {k: v.astype(np.float32) for k, v in base.items()}
    tuned = {}
    for m in ("a", "b", "c"):
        tuned[m] = {
            k: v + np.where(rng.random(v.shape) < 0.4, np.float32(0.01), np.float32(0)) for k, v in base.items() if k != "only_base"
        }
    del tuned["c"]["norm"]
    tuned["a"]["only_a"] = np.ones(3)
    return {"base": base, **tuned}


def expected_masks(models, m):
    return {k: np.abs(models[m][k] - models["base"][k]) >= np.float32(1e-5) for k in models[m] if k in models["base"]}


def test_sparsity(spark, models):
    delta = param_delta(table(spark, models), "base", ["a", "b", "c"])
    per_tensor = update_sparsity(delta)
    found = {(r.model, r.tensor): (r.params, r.unchanged) for r in per_tensor.collect()}
    expected = {
        (m, k): (mask.size, int((~mask).sum())) for m in ("a", "b", "c") for k, mask in expected_masks(models, m).items()
    }
    assert found == expected
    overall = {r.model: r.sparsity for r in overall_sparsity(per_tensor).collect()}
    for m in ("a", "b", "c"):
        masks = expected_masks(models, m).values()
        assert overall[m] == pytest.approx(sum((~x).sum() for x in masks) / sum(x.size for x in masks))


def test_overlap(spark, models):
    names = ["b", "a", "c"]
    rows = update_overlap(param_delta(table(spark, models), "base", names), names).collect()
    found = {(r.model_a, r.model_b): (r.in_both, r.in_either) for r in rows}
    expected = {}
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            mx, my = expected_masks(models, x), expected_masks(models, y)
            common = [k for k in mx if k in my]
            expected[x, y] = (
                int(sum((mx[k] & my[k]).sum() for k in common)), int(sum((mx[k] | my[k]).sum() for k in common))
            )
    assert found == expected


@pytest.mark.parametrize("width", [1, 3, 100])
def test_rows_in_blocks_give_the_same(spark, models, width):
    """A matrix row, or a whole flattened tensor, in several records."""
    names = ["a", "b", "c"]
    whole = param_delta(table(spark, models), "base", names)
    blocks = split_rows(table(spark, models), width)
    assert blocks.agg(F.max(F.size("values"))).first()[0] == min(width, 7)
    delta = param_delta(split_rows(blocks, 2).repartition(3), "base", names)
    same = lambda f: sorted(map(tuple, f(whole).collect())) == sorted(map(tuple, f(delta).collect()))
    assert same(update_sparsity) and same(lambda d: overall_sparsity(update_sparsity(d)))
    assert same(lambda d: update_overlap(d, names))
    assert same(lambda d: delta_rank(d)) and same(lambda d: delta_rank(d, block_cells=9, largest_side=9))


def test_flattened_tensor_of_one_record(spark):
    flat = {"base": {"w": np.zeros(1_000)}, "a": {"w": np.arange(1_000) % 7 == 0}}
    whole = param_delta(table(spark, flat), "base", ["a"])
    delta = param_delta(split_rows(table(spark, flat), 64), "base", ["a"])
    assert delta.count() == 16 and update_sparsity(delta).first() == update_sparsity(whole).first()
    twice = split_rows(split_rows(table(spark, flat), 64), 10)
    assert twice.filter("model = 'a'").agg(F.sum("start"), F.count("*")).first() == tuple(
        (sum(s + k for s in range(0, 1_000, 64) for k in range(0, min(64, 1_000 - s), 10)),
         sum(-(-min(64, 1_000 - s) // 10) for s in range(0, 1_000, 64)))
    )


def test_overlap_edges(spark):
    one = {"base": {V: np.zeros((2, 2))}, "a": {V: np.ones((2, 2))}, "b": {D: np.ones((2, 2))}}
    one["base"][D] = np.zeros((2, 2))
    rows = update_overlap(param_delta(table(spark, one), "base", ["a", "b"]), ["a", "b"]).collect()
    assert [(r.in_both, r.in_either, r.overlap) for r in rows] == [(0, 0, 0.0)]
    twin = {"base": {V: np.zeros((2, 2))}, "a": {V: np.eye(2)}, "b": {V: np.eye(2)}}
    rows = update_overlap(param_delta(table(spark, twin), "base", ["a", "b"]), ["a", "b"]).collect()
    assert [r.overlap for r in rows] == [1.0]
    with pytest.raises(ValueError):
        update_overlap(param_delta(table(spark, twin), "base", ["a"]), ["a"])


def test_nan_is_neither_unchanged_nor_updated(spark):
    data = {"base": {V: [[0.0, 0.0, 0.0, 0.0]]}, "a": {V: [[0.0, float("nan"), 1.0, 5e-6]]}}
    delta = param_delta(table(spark, data), "base", ["a"])
    row = update_sparsity(delta).first()
    assert (row.params, row.unchanged, row.nan) == (4, 2, 1)
    assert delta.select(update_mask(F.col("delta"))).first()[0] == [False, False, True, False]
    assert delta_rank(delta).first()["rank"] is None


def test_shape_mismatch_fails(spark):
    data = {"base": {V: np.zeros((2, 3))}, "a": {V: np.zeros((2, 4))}}
    with pytest.raises(Exception, match="shape mismatch"):
        param_delta(table(spark, data), "base", ["a"]).collect()


@pytest.mark.parametrize("shape", [(50, 4), (4, 50), (9, 9), (1, 6), (37, 5)])
@pytest.mark.parametrize("cells", [9, 40, 4_000_000])
def test_rank_of_blocks_is_the_rank(spark, shape, cells):
    rng = np.random.default_rng(shape[0] * 100 + shape[1])
    data = {"base": {}, "a": {}, "b": {}}
    expected = {}
    for m, rank in (("a", min(shape)), ("b", max(1, min(shape) - 2))):
        low = rng.normal(size=(shape[0], rank)) @ rng.normal(size=(rank, shape[1]))
        data["base"][V] = np.zeros(shape)
        data[m][V] = low
        expected[m] = int(np.linalg.matrix_rank(low.astype(np.float32)))
    delta = param_delta(table(spark, data), "base", ["a", "b"])
    rows = delta_rank(delta, block_cells=cells, largest_side=9).collect()
    assert {r.model: (r["rank"], r.max_rank) for r in rows} == {m: (e, min(shape)) for m, e in expected.items()}


def test_rank_of_long_sides_needs_their_length(spark):
    data = {"base": {V: np.zeros((9, 12))}, "a": {V: np.eye(9, 12)}}
    delta = param_delta(table(spark, data), "base", ["a"])
    with pytest.raises(Exception, match="largest_side"):
        delta_rank(delta, block_cells=9).collect()
    assert delta_rank(delta, block_cells=9, largest_side=9).first()["rank"] == 9
    data["a"][V] = np.full((9, 12), np.inf)
    delta = param_delta(table(spark, data), "base", ["a"])
    assert [tuple(r) for r in delta_rank(delta, block_cells=9, largest_side=9).collect()] == [("a", V, None, 9)]


def test_rank_runs_no_job_before_its_use(spark):
    delta = param_delta(table(spark, {"base": {V: np.zeros((5, 4))}, "a": {V: np.eye(5, 4)}}), "base", ["a"])
    tracker, group = spark.sparkContext.statusTracker(), "planning"
    spark.sparkContext.setJobGroup(group, group)
    ranks = delta_rank(delta)
    assert not tracker.getJobIdsForGroup(group)
    assert ranks.first()["rank"] == 4


def test_rank_near_the_tolerance(spark):
    """Singular values on both sides of the tolerance, through several strips."""
    rng = np.random.default_rng(8)
    left, right = (np.linalg.qr(rng.normal(size=(n, 12)))[0] for n in (30, 20))
    sizes = np.array([1.0, 0.5, 0.1, 1e-2, 1e-3, 1e-4, 1e-5, 2e-6, 1e-9, 0, 0, 0])
    matrix = (left * sizes) @ right.T
    data = {"base": {V: np.zeros((30, 20))}, "a": {V: matrix}, "b": {V: matrix.T}}
    data["base"][D], data["b"][D] = np.zeros((20, 30)), matrix.T
    del data["b"][V]
    del data["a"][V]
    data["a"][V] = matrix
    expected = int((np.linalg.svd(matrix.astype(np.float32).astype(float), compute_uv=False) > 30 * 1.1920929e-07).sum())
    delta = param_delta(table(spark, data), "base", ["a", "b"])
    for cells in (16, 100, 4_000_000):
        rows = delta_rank(delta, block_cells=cells, largest_side=20).collect()
        assert [r["rank"] for r in rows] == [expected] * 2


def test_rank_covers_only_reported_matrices(spark):
    name = "x.mlp.down_proj.weight"
    data = {"base": {V: np.zeros((3, 3)), "other": np.zeros((3, 3)), name: np.zeros(4)}}
    data["a"] = {V: np.eye(3), "other": np.eye(3), name: np.ones(4)}
    rows = delta_rank(param_delta(table(spark, data), "base", ["a"])).collect()
    assert {r.tensor: (r["rank"], r.max_rank) for r in rows} == {V: (3, 3), name: (-1, None)}
    assert delta_rank(param_delta(table(spark, {**data, "a": data["base"]}), "base", ["a"])).filter(
        F.col("tensor") == V
    ).first()["rank"] == 0


def test_report(spark, models):
    report = checkpoint_report(table(spark, models), "base", ["a", "b"])
    assert {r.tensor for r in report["tensors"].collect()} == {V, D}
    assert report["overall"].count() == 2
    assert report["overlap"].count() == 1
    assert "overlap" not in checkpoint_report(table(spark, models), "base", ["a"])
