"""Positions, caps, shuffles, batches and blends."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tunelens.operators.ordering import with_position
from tunelens.operators.sampling import assign_batches, blend, cap_total, expand_samples, first_n, shuffle_epoch, step_plan


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "i")


def shuffled(df, **options):
    return [r.i for r in shuffle_epoch(df, ["i"], **options).orderBy("pos").collect()]


def test_position_within_groups(spark):
    """One group holds most rows and spans several partitions."""
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") < 900, "big").when(F.col("id") < 950, None).otherwise("small").alias("g"))
    placed = with_position(df.repartition(7), ["k"], within=["g"]).collect()
    for group in ("big", None, "small"):
        rows = sorted((r for r in placed if r.g == group), key=lambda r: r.k)
        assert [r.pos for r in rows] == list(range(len(rows)))
    everything = with_position(df, ["k"], "p").orderBy("p").collect()
    assert [r.k for r in everything] == list(range(1000))
    assert [r.p for r in everything] == list(range(1000))


@pytest.mark.parametrize("cap, kept", [(0, {}), (3, {"a": 3}), (5, {"a": 5}), (7, {"a": 5, "b": 2}), (99, {"a": 5, "b": 4})])
def test_cap_total(spark, cap, kept):
    rows = [("b", i) for i in range(4)] + [("a", i) for i in range(5)]
    df = spark.createDataFrame(rows, "split string, idx long")
    got = cap_total(df, cap, ["a", "b"]).collect()
    assert dict(Counter(r.split for r in got)) == kept
    assert all(r.idx < kept[r.split] for r in got)


def test_first_n(spark):
    df = ids(spark, 100).repartition(4)
    assert sorted(r.i for r in first_n(df, 10, pos="i").collect()) == list(range(10))
    assert sorted(r.i for r in first_n(df.withColumn("j", -F.col("i")), 3, order_by=["j"]).collect()) == [97, 98, 99]
    assert first_n(df, 1000, order_by=["i"]).count() == 100


def test_shuffle_is_seeded_and_whole(spark):
    df = ids(spark, 103)
    first = shuffled(df, epoch=0, drop_last=False)
    assert sorted(first) == list(range(103))
    assert first != list(range(103))
    assert first == shuffled(df.repartition(9), epoch=0, drop_last=False)
    assert first != shuffled(df, epoch=1, drop_last=False)
    assert first != shuffled(df, epoch=0, seed=43, drop_last=False)
    assert shuffled(df, epoch=0, batch_size=10) == first[:100]
    assert shuffled(df, epoch=0, batch_size=200) == []


def test_batches_cover_each_row_once(spark):
    df = assign_batches(ids(spark, 23), 5, pos="i")
    sizes = {r.batch: r["count"] for r in df.groupBy("batch").count().collect()}
    assert sizes == {0: 5, 1: 5, 2: 5, 3: 5, 4: 3}
    assert df.select("batch", "slot").distinct().count() == 23


def test_expand(spark):
    rows = expand_samples(ids(spark, 3), 4).collect()
    assert Counter(r.i for r in rows) == {0: 4, 1: 4, 2: 4}
    assert {r.sample_id for r in rows} == {0, 1, 2, 3}


@pytest.mark.parametrize(
    "samples, rollout, train, epochs, expected",
    [(1, 64, 32, 1, (115, 2, 115)), (1, 64, 32, 2, (115, 2, 230)), (1, 64, 32, 3, (115, 2, 345)), (1, 256, 32, 3, (28, 8, 84)), (3, 64, 100, 0.5, (345, 1, 173))],
)
def test_step_plan(spark, samples, rollout, train, epochs, expected):
    row = step_plan(ids(spark, 7376), samples, rollout, train, epochs).first()
    assert (row.iterations_per_epoch, row.updates_per_iteration, row.iterations) == expected


def test_blend(spark):
    one, two = ids(spark, 4000), ids(spark, 500)
    half = blend([(one, 0.5), (two, None)], ["i"])
    counts = dict(Counter(r.source_ord for r in half.collect()))
    assert counts[1] == 500
    assert abs(counts[0] - 2000) < 6 * math.sqrt(1000)
    capped = blend([(one, 0.5), (two, None)], ["i"], cap=100)
    again = blend([(one.repartition(5), 0.5), (two, None)], ["i"], cap=100)
    key = lambda df: sorted((r.source_ord, r.i) for r in df.collect())
    assert len(key(capped)) == 100
    assert key(capped) == key(again)
    assert set(key(capped)) <= set(key(half))
    assert len(key(blend([(two, None)], ["i"], cap=9999))) == 500
    assert key(blend([(one, 0.0)], ["i"])) == []
    assert len(key(blend([(one, 1.0)], ["i"]))) == 4000
