"""Totals worked out beforehand for the adapter tables at sf0.01."""

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: queries()[name](spark, SF).collect()


def test_scorecards(run):
    card = {r.split: (r.total, r.correct, r.wrong, r.no_answer) for r in run("scorecard_combined")}
    assert card == {"validation": (245, 24, 56, 24), "test": (291, 18, 79, 32), "combined": (536, 42, 135, 56)}


def test_sparsity_rank_and_overlap(run):
    assert [(r.model, r.sparsity) for r in sorted(run("overall_sparsity"))] == [("m1", 0.8), ("m2", 0.8), ("m3", 0.8)]
    assert {r["rank"] for r in run("delta_rank") if r.model == "m1"} == {9}
    overlap = {(r.model_a, r.model_b): r.overlap for r in run("update_overlap")}
    assert overlap == {("m1", "m2"): 0.333333, ("m2", "m3"): 0.333333, ("m1", "m3"): 0.0}


def test_gradient_sparsity(spark):
    from pyspark.sql import functions as F

    from tunelens.operators.gradients import grad_sparsity
    from tunelens.plans.adapters import grads

    whole = grad_sparsity(grads(spark, SF).withColumn("step", F.lit(0)))
    found = {r.name: round(r.grad_sparsity, 5) for r in whole.collect()}
    assert found == {"click": 0.18245, "error": 0.18471, "purchase": 0.18173, "signup": 0.17551, "view": 0.18365}
