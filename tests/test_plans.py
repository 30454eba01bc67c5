"""What the physical plans may and may not hold, and independence of partitioning."""

import re

import pytest

from tunelens.plans.registry import QUERIES
from tunelens.plans import adapters as a
from tunelens.plans.evaluation_queries import KEYS
from tunelens.operators.evaluation import scorecard
from tunelens.operators.gradients import grad_metrics
from tunelens.operators.reward_table import total_reward, with_rewards
from tests.oracle import rows_of

# Divergences and trigrams run as Arrow kernels and ranks as grouped numpy; everything else stays in the JVM.
PYTHON_STAGES = {
    "log_softmax", "log_mixture", "pointwise_jsd", "position_jsd", "divergence_loss", "divergence_loss_clipped",
    "divergence_loss_unclipped", "reverse_kl", "token_entropy", "sampling_rollup", "delta_rank",
    "rewards_documents", "rewards_completions",
}


@pytest.fixture(scope="module")
def plans(spark):
    return {
        name: query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        for name, query in QUERIES.items()
    }


def test_no_cartesian_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_python_only_where_declared(plans):
    markers = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsIn", "MapInPandas", "MapInArrow")
    found = {name for name, plan in plans.items() if any(m in plan for m in markers)}
    assert found == PYTHON_STAGES


def test_windows_over_data_are_partitioned(plans):
    """Without partition keys only summary rows (per bucket, split or task) are windowed."""
    for name, plan in plans.items():
        for line in plan.splitlines():
            if any(re.search(r" (ASC|DESC) ", spec) for spec in re.findall(r"windowspecdefinition\(([^,]*)", line)):
                assert "__rows" in line or "__size" in line, (name, line)


def test_scans_read_only_what_is_used(plans):
    schema = lambda name: re.findall(r"ReadSchema: struct<([^>]*)>", plans[name])
    assert schema("grad_norm") == ["event_id:bigint,event_type:string,value:double"]
    assert schema("row_count") == [""] or all(not s for s in schema("row_count"))
    assert all("text" not in s for s in schema("expand_samples"))
    samples_side = [s for s in schema("scorecard") if "text" not in s]
    assert samples_side, "the side of the samples reads no text"


def test_filters_reach_the_scan(plans):
    assert "EqualTo(role,assistant)" in plans["scorecard"]
    assert "EqualTo(loss_mask" not in plans["position_jsd"]  # derived column, stays a filter above the scan


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_partition_independence(spark, parts):
    sf = "/root/testdata/sf0.001"
    completions = a.completions(spark, sf)
    graded = lambda df: total_reward(with_rewards(df)).select("prompt_id", "sample_id", "reward")
    assert rows_of(["a", "b", "c"], graded(completions.repartition(parts)).collect()) == rows_of(["a", "b", "c"], graded(completions).collect())
    samples, responses = a.samples(spark, sf), a.model_responses(spark, sf).filter("model = 'm0'").drop("model")
    card = lambda s, r: rows_of(list("abcdefg"), scorecard(s, r, KEYS, combined=True).collect())
    assert card(samples.repartition(parts), responses.repartition(parts, "response")) == card(samples, responses)
    grads = a.grads(spark, sf)
    metric = lambda df: {(r.step, r.name): (round(r.grad_norm, 12), r.grad_sparsity) for r in grad_metrics(df).collect()}
    assert metric(grads.repartition(parts)) == metric(grads)
