"""Run folders, gradients in batch and as a stream."""

import json
import math
import random
import re

from pyspark.sql import functions as F

from tunelens.operators.gradients import grad_metrics, to_metrics
from tunelens.operators.rollups import length_rollup, phase_rollup, reward_rollup, sampling_rollup
from tunelens.operators.runs import args_to_map, failure_reason, pointer_runs
from tunelens.sources.runs import load_runs, read_run_files, read_run_logs
from tunelens.streaming.gradients import latest_metrics, start_metrics, streaming_metrics

POINTER = "version https://git-lfs.github.com/spec/v1\noid sha256:0\nsize 5\n"


def folder(root, run, **files):
    path = root / f"run-{run}" / "files"
    path.mkdir(parents=True)
    for name, text in files.items():
        (path / name).write_text(text)


def test_catalogue(spark, tmp_path):
    folder(tmp_path, "a1", summary=json.dumps({"_step": 3, "train/loss": 1.5e-05, "_inner": {"runtime": 7}, "note": "x"}))
    folder(tmp_path, "b2", summary=json.dumps({"_step": 1.7762776905767827e09}))
    folder(tmp_path, "c3", summary=POINTER)
    runs = {r.run_id: r for r in load_runs(spark, f"{tmp_path}/*/files/summary").collect()}
    assert set(runs) == {"a1", "b2"}
    assert runs["a1"].metrics == {"_step": 3.0, "train/loss": 1.5e-05}
    assert json.loads(runs["a1"].nested["_inner"]) == {"runtime": 7}
    assert runs["a1"].nested["note"] == "x"
    assert runs["b2"].metrics["_step"] == 1776277690.5767827
    files = {r.run_id: r.pointer for r in read_run_files(spark, f"{tmp_path}/*/files/summary").collect()}
    assert files == {"a1": False, "b2": False, "c3": True}


def test_arguments(spark):
    rows = [(0, ["--a", "1", "--b", "x", "--a", "2"]), (1, ["-v"]), (2, [])]
    df = spark.createDataFrame(rows, "i int, args array<string>")
    got = [r[1] for r in df.select("i", args_to_map(F.col("args"))).orderBy("i").collect()]
    assert got == [{"b": "x", "a": "2"}, {"v": None}, {}]


FRAME = "Traceback (most recent call last):\n  File \"x\", line 1\n    go()\n"


def test_failures(spark, tmp_path):
    log = f"start\nValueError: only logged\n{FRAME}KeyError: 1\n\nDuring handling\n\n{FRAME}"
    log += "pkg.errors.TaskError(OutOfMemoryError): last one\ntail\n  shifted\nTypeError: logged\n"
    folder(tmp_path, "a1", log=log)
    folder(tmp_path, "b2", log="fine\nNotAnErrorLine here\n  indented\nValueError: logged\n")
    folder(tmp_path, "c3", log=f"{FRAME}KeyboardInterrupt\n")
    folder(tmp_path, "d4", log=POINTER)
    folder(tmp_path, "e5", log=f"{FRAME}TaskError(Inner): outer\n      ^^^\n  File y\nInner: cause\nend\n")
    folder(tmp_path, "f6", log="ValueError: logged\n" + FRAME)
    logs = read_run_logs(spark, f"{tmp_path}/*/files/log")
    assert [r.run_id for r in pointer_runs(logs).collect()] == ["d4"]
    expected = {
        "a1": "pkg.errors.TaskError(OutOfMemoryError): last one", "c3": "KeyboardInterrupt", "e5": "Inner: cause",
    }
    for section in (1, 2, 3, 5, 4_096):
        rows = failure_reason(logs, section_lines=section).collect()
        assert {r.run_id: r.reason for r in rows} == expected


def plain_reason(lines):
    """Line by line: the last line that closes a traceback."""
    found, state, prior = None, False, None
    for line in lines:
        if line.startswith("Traceback (most"):
            state, prior = True, "opens"
        elif not line.strip():
            prior = "blank"
        elif line[0] in " \t":
            prior = "inner"
        else:
            state = state and prior in ("opens", "inner") if prior in ("opens", "inner") else False
            if state and re.match(r"[A-Za-z_][\w.]*(\(\w*\))?(:|$)", line):
                found = line
            prior = "other"
    return found


def test_failures_of_any_log(spark):
    rng = random.Random(3)
    kinds = ["Traceback (most recent call last):", "  File x", "\tgo()", "", "plain text", "KeyError: {}", "pkg.E(Cause): {}", "  "]
    logs = {i: [rng.choice(kinds).format(rng.random()) for _ in range(rng.randint(1, 30))] for i in range(200)}
    rows = [(i, n, line) for i, log in logs.items() for n, line in enumerate(log)]
    frame = spark.createDataFrame(rows, "run_id long, line_no long, value string").repartition(4)
    expected = {i: r for i, log in logs.items() if (r := plain_reason(log))}
    assert 50 < len(expected) < 200
    for section in (3, 4_096):
        assert {r.run_id: r.reason for r in failure_reason(frame, section_lines=section).collect()} == expected


GRADS = [(0, "w", 3e-7), (0, "w", -4.0), (0, "b", None), (1, "w", 0.0), (1, "b", 3.0), (1, "b", 4.0)]


def test_gradients(spark):
    df = spark.createDataFrame(GRADS, "step long, name string, grad double")
    got = {(r.step, r.metric): r.value for r in to_metrics(grad_metrics(df)).collect()}
    assert got == {
        (0, "grad_norm/w"): math.sqrt(16 + 9e-14), (0, "grad_sparsity/w"): 0.5,
        (1, "grad_norm/w"): 0.0, (1, "grad_sparsity/w"): 1.0,
        (1, "grad_norm/b"): 5.0, (1, "grad_sparsity/b"): 0.0,
    }
    assert to_metrics(grad_metrics(df.limit(0))).collect() == []


def test_gradient_stream_over_several_batches(spark, tmp_path):
    """A step's gradients arrive in two files; the newest update is the whole step."""
    schema = "step long, name string, grad double, logged_at timestamp"
    parts = [GRADS[:1] + GRADS[3:5], GRADS[1:3] + GRADS[5:]]
    for part in parts:
        df = spark.createDataFrame(part, "step long, name string, grad double")
        df.withColumn("logged_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("step"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_metrics(streaming_metrics(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.step, r.name): (r.grad_norm, r.grad_sparsity, r.entries) for r in latest_metrics(spark, str(tmp_path / "out")).collect()}
    assert got == {(0, "w"): (math.sqrt(16 + 9e-14), 0.5, 2), (1, "w"): (0.0, 1.0, 1), (1, "b"): (5.0, 0.0, 2)}
    assert len(list((tmp_path / "out").glob("batch_id=*"))) == 2


def by_metric(df, *keys):
    return {(*[r[k] for k in keys], r.metric): r.value for r in df.collect()}


def test_reward_rollup_uses_the_sample_deviation(spark):
    rows = [(0, p, 2.0 if p < 3 else 0.0) for p in range(4) for _ in range(2)]
    df = spark.createDataFrame(rows, "step int, prompt_id int, correctness double").withColumn("reward", F.col("correctness"))
    got = by_metric(reward_rollup(df, ["correctness"]), "step")
    assert got[0, "rewards/correctness/mean"] == 1.5
    assert round(got[0, "rewards/correctness/std"], 4) == 0.9258
    assert got[0, "frac_reward_zero_std"] == 1.0


def test_length_rollup(spark):
    rows = [(0, 10, 5, True), (0, 20, 5, False), (1, 15, 5, False), (1, 20, 5, False)]
    df = spark.createDataFrame(rows, "step int, n_tokens long, prompt_tokens long, finished boolean")
    got = by_metric(length_rollup(df, limit=20), "step")
    assert got[0, "completions/mean_length"] == 15.0
    assert got[0, "completions/max_terminated_length"] == 10.0
    assert got[1, "completions/mean_terminated_length"] is None
    assert (got[0, "completions/clipped_ratio"], got[1, "completions/clipped_ratio"]) == (0.5, 0.5)
    assert (got[0, "num_tokens"], got[1, "num_tokens"]) == (40.0, 85.0)
    assert (got[1, "response_length"], got[1, "total_length"]) == (17.5, 22.5)


def test_sampling_rollup(spark):
    rows = [
        (0, 0, 0, math.log(0.5), 0.0, -1.0, 1.0), (0, 0, 0, math.log(0.5), 0.0, 1.0, 3.0),
        (0, 1, 1, math.log(2.0), 0.0, 1.0, 2.0), (0, 1, 1, 0.0, 0.0, 1.0, 2.0),
    ]
    df = spark.createDataFrame(rows, "step int, worker int, seq_id int, logp_train double, logp_sampler double, advantage double, entropy double")
    got = {k: round(v, 6) for k, v in by_metric(sampling_rollup(df), "step").items()}
    assert got[0, "sampling/importance_sampling_ratio/min"] == 0.25
    assert got[0, "sampling/importance_sampling_ratio/max"] == 2.0
    assert got[0, "sampling/importance_sampling_ratio/mean"] == 1.125
    assert (got[0, "clip_ratio/low_mean"], got[0, "clip_ratio/low_min"]) == (0.25, 0.0)
    assert (got[0, "clip_ratio/high_mean"], got[0, "clip_ratio/high_max"]) == (0.25, 0.5)
    assert (got[0, "clip_ratio/region_mean"], got[0, "entropy"]) == (0.5, 2.0)
    assert got[0, "sampling/sampling_logp_difference/max"] == round(math.log(2), 6)


def test_phases(spark):
    rows = [("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 12.0), ("b", "x", 0.0)]
    got = {(r.run_id, r.phase): (r.mean_seconds, r.total_seconds, r.share) for r in phase_rollup(spark.createDataFrame(rows, "run_id string, phase string, seconds double")).collect()}
    assert got == {("a", "x"): (2.0, 4.0, 0.25), ("a", "y"): (12.0, 12.0, 0.75), ("b", "x"): (0.0, 0.0, 0.0)}
