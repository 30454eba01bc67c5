"""Nothing is lost at null keys, and a hot key can be split."""

import pytest
from pyspark.sql import functions as F

from tunelens.operators.evaluation import compare_models, scorecard
from tunelens.operators.ordering import with_position
from tunelens.operators.reward_table import advantage
from tunelens.operators.runs import parse_summaries
from tunelens.operators.sampling import first_n
from tunelens.streaming.gradients import latest_metrics, start_metrics, streaming_metrics


def test_null_keys_stay(spark):
    rows = spark.createDataFrame([(None, 1, 1.0), (None, 2, 3.0), (7, 3, 5.0)], "prompt_id long, k long, reward double")
    assert sorted(r.advantage for r in advantage(rows).collect())[1] == 0
    assert advantage(rows).count() == 3
    named = spark.createDataFrame([(None, 1), (2, 5), (3, 0)], "k long, x long")
    placed = {(r.k, r.x): r.pos for r in with_position(named, ["x"], key=["k"]).collect()}
    assert placed == {(3, 0): 0, (None, 1): 1, (2, 5): 2}
    assert {r.k for r in first_n(named, 2, order_by=["x"], key=["k"]).collect()} == {3, None}


def test_a_hot_prompt_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(60_000).repartition(8)
        prompt = F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id"))
        rows = ids.select(prompt.alias("prompt_id"), F.rand(1).alias("reward"), F.md5(F.col("id").cast("string")).alias("x"))
        out = advantage(rows)
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stream_adds_up_arrival_times(spark, tmp_path):
    schema = "step long, name string, logged_at timestamp, grad double"
    batches = [[(1, "w", 0, 3.0)], [(1, "w", 1, 4.0), (2, "w", 2, 1e-9)], [(1, "w", 0, 12.0)]]
    for i, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, "step long, name string, at long, grad double")
        timed = frame.withColumn("logged_at", F.timestamp_seconds(F.col("at") + 1_000_000))
        timed.select("step", "name", "logged_at", "grad").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = str(tmp_path / "out")
    start_metrics(streaming_metrics(stream), table, str(tmp_path / "state")).awaitTermination()
    found = {r.step: (r.grad_norm, r.grad_sparsity, r.entries) for r in latest_metrics(spark, table).collect()}
    assert found[1] == (13.0, 0.0, 3) and found[2][2] == 1


def test_text_that_looks_like_a_number_stays_text(spark):
    text = '{"run":"42","commit":"1e5","_step":3,"x":2.5,"deep":{"a":1},"none":null}'
    row = parse_summaries(spark.createDataFrame([(text,)], "text string")).first()
    assert row.metrics == {"_step": 3.0, "x": 2.5}
    assert row.nested == {"run": "42", "commit": "1e5", "deep": '{"a":1}', "none": None}


def test_empty_splits_have_rows(spark):
    samples = spark.createDataFrame([], "split string, idx long, correct_option int")
    responses = spark.createDataFrame([], "model string, split string, idx long, response string")
    card = {r.split: (r.total, r.correct) for r in scorecard(samples, responses, combined=True, splits=["a"]).collect()}
    assert card == {"a": (0, 0), "combined": (0, 0)}


@pytest.mark.parametrize("splits", [None, ["x"]])
def test_all_splits_unless_named(spark, splits):
    samples = spark.createDataFrame([("x", 0, 1), ("extra", 0, 1)], "split string, idx long, correct_option int")
    responses = spark.createDataFrame([("m", "x", 0, "#### 2")], "model string, split string, idx long, response string")
    found = {r.split: (r.total, r.correct) for r in compare_models(samples, responses, splits).collect()}
    assert found == ({"x": (1, 1), "extra": (1, 0)} if splits is None else {"x": (1, 1)})
