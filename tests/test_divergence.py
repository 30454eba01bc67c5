"""Divergence kernels against worked values and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelens.functions.divergence import divergence, entropy, log_mixture, log_softmax, mask_vocab, pointwise_jsd, softmax
from tunelens.operators.logits import divergence_loss, position_divergence, split_position_divergence

SCHEMA = "seq_id long, pos int, loss_mask boolean, student_logits array<float>, teacher_logits array<float>"


def logits(spark, pairs, mask=None):
    rows = [(0, i, True if mask is None else mask[i], list(map(float, s)), list(map(float, t))) for i, (s, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCHEMA)


def losses(spark, pairs, **options):
    rows = position_divergence(logits(spark, pairs), **options).orderBy("pos").collect()
    return [r.divergence for r in rows]


@pytest.mark.parametrize(
    "student, teacher, options, value",
    [
        ([0, 0], [0, 0], {}, 0.0),
        ([1, 0], [0, 1], {}, 0.110944),
        ([1, 0], [0, 1], {"clip": 0.1}, -0.066774),
        ([2, 0, 0], [0, 1, 0], {}, 0.185749),
        ([1, 0], [0, 1], {"loss": "rkl", "clip": None}, 0.462117),
    ],
)
def test_worked_values(spark, student, teacher, options, value):
    assert losses(spark, [(student, teacher)], **options) == pytest.approx([value], abs=1e-6)


def test_pointwise_terms(spark):
    df = logits(spark, [([2, 0, 0], [0, 1, 0])])
    terms = df.select(pointwise_jsd(F.col("student_logits"), F.col("teacher_logits"))).first()[0]
    assert terms == pytest.approx([0.088071, 0.088784, 0.008894], abs=1e-6)


def test_against_numpy(spark):
    rng = np.random.default_rng(7)
    pairs = [(rng.normal(size=n) * 3, rng.normal(size=n) * 3) for n in (3, 40, 1, 17)]
    df = logits(spark, pairs)
    temperature, beta = 2.0, 0.3
    columns = df.select(
        "pos",
        softmax(F.col("student_logits"), temperature).alias("ps"),
        log_softmax(F.col("student_logits"), temperature).alias("ls"),
        log_mixture(
            log_softmax(F.col("teacher_logits"), temperature), log_softmax(F.col("student_logits"), temperature), beta
        ).alias("lm"),
        entropy(F.col("student_logits"), temperature).alias("h"),
        divergence("jsd")(F.col("student_logits"), F.col("teacher_logits"), beta=beta, clip=None, temperature=temperature).alias("d"),
    ).orderBy("pos").collect()
    for row, (s, t) in zip(columns, pairs):
        ps, pt = (np.exp(np.float32(x) / temperature) for x in (s, t))
        ps, pt = ps / ps.sum(), pt / pt.sum()
        m = beta * pt + (1 - beta) * ps
        assert row.ps == pytest.approx(ps, rel=1e-5)
        assert row.ls == pytest.approx(np.log(ps), rel=1e-4, abs=1e-6)
        assert row.lm == pytest.approx(np.log(m), rel=1e-4, abs=1e-6)
        assert row.h == pytest.approx(-(ps * np.log(ps)).sum(), rel=1e-5, abs=1e-6)
        expected = beta * (pt * np.log(pt / m)).sum() + (1 - beta) * (ps * np.log(ps / m)).sum()
        assert row.d == pytest.approx(expected, rel=1e-4, abs=1e-6)


def test_bounds(spark):
    rng = np.random.default_rng(3)
    pairs = [(rng.normal(size=20) * 30, rng.normal(size=20) * 30) for _ in range(20)]
    values = losses(spark, pairs, clip=None)
    assert all(-1e-12 <= v <= math.log(2) + 1e-9 for v in values)
    assert losses(spark, [(s, s) for s, _ in pairs], clip=None) == pytest.approx([0.0] * 20, abs=1e-12)
    assert losses(spark, pairs) == pytest.approx(values)  # a clip of 10 never binds


def test_masked_vocabulary(spark):
    pairs = [([2, 0, 0], [0, 1, 0])]
    assert losses(spark, pairs, mask_ids=[0]) == pytest.approx([0.088784 + 0.008894], abs=1e-6)
    row = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>").select(mask_vocab(F.col("a"), [0, 2])).first()
    assert row[0] == [0.0, 2.0, 0.0]


def test_only_response_positions_count(spark):
    pairs = [([1, 0], [0, 1]), ([5, 0], [0, 1]), ([1, 0], [0, 1])]
    df = logits(spark, pairs, mask=[True, False, True])
    row = divergence_loss(df).first()
    assert (row.tokens, row.loss) == (2, pytest.approx(0.110944, abs=1e-6))
    assert divergence_loss(df, avg_tokens=4).first().loss == pytest.approx(0.110944 / 2, abs=1e-6)
    assert divergence_loss(df, clip=0).first().loss == pytest.approx(0.110944, abs=1e-6)


def test_null_and_empty_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [3.0])]
    df = spark.createDataFrame(rows, "i int, a array<double>")
    got = [r[1] for r in df.select("i", log_softmax(F.col("a"))).orderBy("i").collect()]
    assert got[0] == pytest.approx([-1.313262, -0.313262], abs=1e-6)
    assert got[1:] == [None, [], [0.0]]
    got = [r[1] for r in df.select("i", entropy(F.col("a"))).orderBy("i").collect()]
    assert got[0] == pytest.approx(0.582203, abs=1e-6)
    assert got[1:] == [None, 0.0, 0.0]


def test_unequal_rows_are_an_error(spark):
    with pytest.raises(Exception, match="differ in length"):
        losses(spark, [([1, 0], [0, 1, 2])])


def test_unknown_loss():
    with pytest.raises(ValueError, match="unknown divergence"):
        divergence("nope")


def test_slices_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = [(rng.normal(size=9), rng.normal(size=9)) for _ in range(50)]
    whole = losses(spark, pairs)
    monkeypatch.setattr("tunelens.functions.divergence.SLICE_CELLS", 20)
    assert losses(spark, pairs) == pytest.approx(whole, rel=1e-12)
    df = logits(spark, pairs)
    rows = df.select("pos", log_softmax(F.col("student_logits")).alias("l")).orderBy("pos").collect()
    assert all(sum(np.exp(r.l)) == pytest.approx(1.0) for r in rows)


@pytest.mark.parametrize(
    "options",
    [{}, {"clip": 0.01, "beta": 0.3}, {"temperature": 2.5, "mask_ids": (0, 7, 11)}, {"loss": "rkl", "clip": None, "mask_ids": (4,)}],
)
def test_split_vocabulary_equals_the_whole(spark, options):
    """Blocks of uneven width, in any order, with logits far apart and positions that do not count."""
    rng = np.random.default_rng(4)
    pairs = [(rng.normal(size=12) * scale, rng.normal(size=12) * scale) for scale in (1, 5, 60, 1) for _ in range(5)]
    mask = [i % 4 != 3 for i in range(len(pairs))]
    whole = logits(spark, pairs, mask)
    expected = {r.pos: r.divergence for r in position_divergence(whole, **options).collect()}
    rows = []
    for i, (student, teacher) in enumerate(pairs):
        cuts = sorted({0, *rng.integers(1, 12, 3).tolist(), 12})
        rows += [(i, mask[i], a, list(map(float, student[a:b])), list(map(float, teacher[a:b]))) for a, b in zip(cuts, cuts[1:])]
    schema = "pos int, loss_mask boolean, start int, student_logits array<float>, teacher_logits array<float>"
    blocks = spark.createDataFrame(rows, schema).repartition(5)
    found = {r.pos: r.divergence for r in split_position_divergence(blocks, ["pos"], **options).collect()}
    assert found.keys() == expected.keys()
    assert [found[k] for k in sorted(found)] == pytest.approx([expected[k] for k in sorted(found)], abs=1e-9)


def test_split_vocabulary_shuffles_logits_once(spark):
    schema = "pos int, loss_mask boolean, start int, student_logits array<float>, teacher_logits array<float>"
    found = split_position_divergence(spark.createDataFrame([(0, True, 0, [1.0], [2.0])], schema), ["pos"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    shares, blocks = plan.split("Exchange ")[1:]
    assert "partial_sum" in shares.splitlines()[1] and "student_logits" in blocks.splitlines()[1]
    assert found.first().divergence == pytest.approx(0, abs=1e-12)
