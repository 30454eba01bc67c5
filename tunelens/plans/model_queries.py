"""Registered queries: logits, checkpoints, gradients and run data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelens.functions.common import int_div
from tunelens.functions.divergence import entropy, log_mixture, log_softmax, mask_vocab, pointwise_jsd
from tunelens.functions.vectors import update_mask
from tunelens.operators.checkpoints import (
    overall_sparsity,
    param_delta,
    select_tensors,
    split_rows,
    update_overlap,
    update_sparsity,
)
from tunelens.operators.gradients import grad_metrics, grad_norm, grad_sparsity, to_metrics
from tunelens.operators.logits import divergence_loss, position_divergence, split_position_divergence
from tunelens.operators.ranks import delta_rank
from tunelens.operators.runs import POINTER_START, args_to_map, failure_reason, is_pointer, pointer_runs
from tunelens.plans import adapters as a
from tunelens.plans.checkpoint_report import checkpoint_report
from tunelens.plans.evaluation_queries import rounded
from tunelens.session import work_path
from tunelens.sources.runs import load_runs, read_run_logs
from tunelens.streaming.gradients import latest_metrics, start_metrics, streaming_metrics

MASKED = (3, 17)
TEMPERATURE = 2.0
BETA = 0.3
CLIP = 0.001
ANY_ORDER = "3650 days"  # files may come in any order, so nothing counts as late
FIRST_STEP_AT = 1_704_067_200  # seconds; a stream drops rows at or before the epoch as late


def _cells(df: DataFrame, **arrays) -> DataFrame:
    """(vec_id, i, columns) rows of arrays of equal length."""
    zipped = F.arrays_zip(*[F.col(n) for n in arrays])
    wide = df.select("vec_id", *[c.alias(n) for n, c in arrays.items()])
    return wide.select("vec_id", F.posexplode(zipped).alias("i", "cell")).select(
        "vec_id", "i", *[(F.round(F.col(f"cell.{n}"), 6) + F.lit(0.0)).alias(n) for n in arrays]
    )


def q_log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.logits(spark, sf_dir)
    return _cells(
        rows,
        log_student=log_softmax(F.col("student_logits"), TEMPERATURE),
        log_teacher=log_softmax(F.col("teacher_logits"), TEMPERATURE),
    )


def q_log_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.logits(spark, sf_dir)
    mixed = log_mixture(log_softmax(F.col("teacher_logits")), log_softmax(F.col("student_logits")), BETA)
    return _cells(rows, log_mixture=mixed)


def q_pointwise_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = mask_vocab(pointwise_jsd(F.col("student_logits"), F.col("teacher_logits"), clip=CLIP), MASKED)
    return _cells(a.logits(spark, sf_dir), term=terms)


def q_position_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_position = position_divergence(a.logits(spark, sf_dir), mask_ids=MASKED)
    return per_position.select("vec_id", "seq_id", "pos", rounded("divergence"))


def _split_logits(spark: SparkSession, sf_dir: str, blocks: int = 4) -> DataFrame:
    """Each position's logits as so many rows."""
    width = a.VOCAB // blocks
    rows = a.logits(spark, sf_dir).withColumn("start", F.explode(F.array(*[F.lit(b * width) for b in range(blocks)])))
    part = lambda c: F.slice(c, F.col("start") + 1, F.lit(width)).alias(c)
    return rows.select("vec_id", "seq_id", "pos", "loss_mask", "start", part("student_logits"), part("teacher_logits"))


def q_split_position_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split_logits(spark, sf_dir)
    found = split_position_divergence(rows, ["vec_id", "seq_id", "pos"], mask_ids=MASKED)
    return found.select("vec_id", "seq_id", "pos", rounded("divergence"))


def q_split_reverse_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split_position_divergence(_split_logits(spark, sf_dir), ["vec_id", "seq_id", "pos"], loss="rkl", clip=None)
    return found.select("vec_id", "seq_id", "pos", rounded("divergence"))


def q_divergence_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_loss(a.logits(spark, sf_dir), by=["seq_id"], avg_tokens=7).select("seq_id", "tokens", rounded("loss"))


def q_divergence_loss_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = divergence_loss(a.logits(spark, sf_dir), beta=BETA, clip=CLIP, temperature=TEMPERATURE)
    return loss.select("tokens", rounded("loss"))


def q_divergence_loss_unclipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_loss(a.logits(spark, sf_dir), clip=0.0).select("tokens", rounded("loss"))


def q_reverse_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_position = position_divergence(a.logits(spark, sf_dir), loss="rkl", clip=None)
    return per_position.select("vec_id", "seq_id", "pos", rounded("divergence"))


def q_token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.logits(spark, sf_dir).select("vec_id", entropy(F.col("student_logits")).alias("entropy"))
    return rows.select("vec_id", rounded("entropy"))


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return param_delta(a.params(spark, sf_dir), a.BASE, a.TUNED)


def q_param_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = _delta(spark, sf_dir)
    total = F.aggregate("delta", F.lit(0.0), lambda s, x: s + x.cast("double"))
    largest = F.array_max(F.transform("delta", lambda x: F.abs(x)))
    return (
        delta.select("model", "tensor", total.alias("total"), largest.cast("double").alias("largest"))
        .groupBy("model", "tensor")
        .agg(F.count("*").alias("rows"), F.sum("total").alias("total"), F.max("largest").alias("largest"))
        .select("model", "tensor", "rows", rounded("total"), rounded("largest"))
    )


def q_update_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update_sparsity(_delta(spark, sf_dir)).select("model", "tensor", "params", "unchanged", rounded("sparsity"))


def q_reported_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = update_sparsity(select_tensors(_delta(spark, sf_dir)))
    return chosen.select("model", "tensor", "params", rounded("sparsity"))


def q_overall_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    overall = overall_sparsity(update_sparsity(_delta(spark, sf_dir)))
    return overall.select("model", "params", "unchanged", rounded("sparsity"))


def q_delta_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_rank(_delta(spark, sf_dir))


def _blocked_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of rows that come in records of 24 entries."""
    return param_delta(split_rows(a.params(spark, sf_dir), 24), a.BASE, a.TUNED)


def q_blocked_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update_sparsity(_blocked_delta(spark, sf_dir)).select("model", "tensor", "params", "unchanged", rounded("sparsity"))


def q_blocked_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    overlap = update_overlap(_blocked_delta(spark, sf_dir), a.TUNED)
    return overlap.select("model_a", "model_b", "in_both", "in_either", rounded("overlap"))


def q_blocked_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_rank(_blocked_delta(spark, sf_dir), block_cells=2_500)


def q_checkpoint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reported tensors of every tuned model, with sparsity and rank side by side."""
    tensors = checkpoint_report(a.params(spark, sf_dir), a.BASE, a.TUNED)["tensors"]
    return tensors.select("model", "tensor", "params", rounded("sparsity"), "rank", "max_rank")


def q_update_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _delta(spark, sf_dir).select("model", "tensor", F.posexplode(update_mask(F.col("delta"))).alias("i", "updated"))
    return marked.groupBy("model", "tensor", "i").agg(F.count_if("updated").alias("updated"))


def q_update_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    overlap = update_overlap(_delta(spark, sf_dir), a.TUNED)
    return overlap.select("model_a", "model_b", "in_both", "in_either", rounded("overlap"))


def q_grad_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    norms = grad_norm(a.grads(spark, sf_dir))
    return norms.select("step", "name", rounded("grad_norm", 9))


def q_grad_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grad_sparsity(a.grads(spark, sf_dir)).select("step", "name", rounded("grad_sparsity"))


def q_grad_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_metrics(grad_metrics(a.grads(spark, sf_dir))).select("step", "metric", rounded("value", 9))


def q_streaming_grad_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metrics from the events as a stream of several files and batches.

    Gradients of a step arrive at different times and in different files.
    """
    events = a.table(spark, sf_dir, "events")
    source = work_path(spark, "stream-source")
    events.repartition(3, F.col("event_id")).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    step = int_div(F.col("event_id"), 1000)
    grads = stream.select(
        step.alias("step"),
        F.timestamp_seconds(step * 60 + F.col("event_id") % 3 + FIRST_STEP_AT).alias("logged_at"),
        F.col("event_type").alias("name"),
        (F.col("value") * 1e-7).alias("grad"),
    )
    table = work_path(spark, "stream")
    start_metrics(streaming_metrics(grads, lateness=ANY_ORDER), table, work_path(spark, "stream-state")).awaitTermination()
    return latest_metrics(spark, table).select(
        "step", "name", rounded("grad_norm", 9), rounded("grad_sparsity"), "entries"
    )


def _run_name():
    return F.concat_ws("-", F.col("event_type"), (F.col("user_id") % 8).cast("string"))


def q_run_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary file per run, written and catalogued."""
    root = work_path(spark, "runs")
    summary = a.table(spark, sf_dir, "events").groupBy(_run_name().alias("run_id")).agg(
        F.count("*").alias("_step"),
        F.round(F.sum("value"), 4).alias("train/value"),
        F.max("value").alias("train/max"),
        F.struct(F.max("event_id").alias("last")).alias("_nested"),
    )
    text = F.to_json(F.struct("_step", "train/value", "train/max", "_nested"))
    summary.select("run_id", text.alias("value")).repartition("run_id").write.partitionBy("run_id").text(root)
    runs = load_runs(spark, root, r"run_id=([^/]+)")
    return runs.select(
        "run_id",
        F.col("metrics")["_step"].alias("step"),
        F.round(F.col("metrics")["train/value"], 4).alias("value"),
        F.col("metrics")["train/max"].alias("largest"),
        F.size("metrics").alias("n_metrics"),
        F.col("nested")["_nested"].alias("nested"),
    )


def q_run_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternating flags and values per event; one flag is given twice."""
    event = F.col("event_id").cast("string")
    args = F.array(
        F.lit("--event"), F.lit("none"), F.lit("--type"), F.col("event_type"),
        F.lit("--user_id"), F.col("user_id").cast("string"), F.lit("--event"), event,
    )
    flags = args_to_map(args)
    return a.table(spark, sf_dir, "events").select("event_id", flags.alias("flags")).select(
        "event_id",
        F.size("flags").alias("n_flags"),
        F.col("flags")["event"].alias("event"),
        F.col("flags")["type"].alias("type"),
        F.col("flags")["user_id"].alias("user_id"),
    )


def q_pointer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stub = F.concat(F.lit("version https://git-lfs.github.com/spec/v1\nsize "), F.col("n_chars").cast("string"))
    content = F.when(F.col("doc_id") % 10 == 0, stub).otherwise(F.col("text"))
    return (
        a.table(spark, sf_dir, "documents")
        .select("source", is_pointer(content).alias("pointer"))
        .groupBy("source")
        .agg(F.count_if("pointer").alias("pointers"), F.count("*").alias("files"))
    )


def q_failure_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failure_reason(a.log_lines(spark, sf_dir))


def _written_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs written as one file per source of documents, every third one a pointer, and read back."""
    root = work_path(spark, "logs")
    lines = a.log_lines(spark, sf_dir).withColumn("run", F.concat(F.lit("r"), F.col("run_id") % 8))
    stub = spark.range(8).select(F.concat(F.lit("r"), F.col("id")).alias("run"), F.lit(POINTER_START).alias("value"))
    whole = lines.filter(F.col("run_id") % 8 % 3 != 0)
    rows = whole.repartition("run").sortWithinPartitions("run", "run_id", "line_no").select("run", "value")
    rows.write.partitionBy("run").text(root)
    stub.filter(F.substring("run", 2, 1).cast("int") % 3 == 0).repartition("run").write.mode("append").partitionBy("run").text(root)
    return read_run_logs(spark, root, r"run=([^/]+)")


def q_run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, failure and pointers of log files that were written and read back."""
    lines = _written_logs(spark, sf_dir)
    counted = lines.groupBy("run_id").agg(F.count("*").alias("lines"))
    pointers = pointer_runs(lines).withColumn("pointer", F.lit(True))
    found = counted.join(failure_reason(lines, section_lines=1_000), "run_id", "left").join(pointers, "run_id", "left")
    return found.select("run_id", "lines", "reason", F.coalesce("pointer", F.lit(False)).alias("pointer"))


QUERIES = {
    "log_softmax": q_log_softmax,
    "log_mixture": q_log_mixture,
    "pointwise_jsd": q_pointwise_jsd,
    "position_jsd": q_position_jsd,
    "split_position_jsd": q_split_position_jsd,
    "split_reverse_kl": q_split_reverse_kl,
    "divergence_loss": q_divergence_loss,
    "divergence_loss_clipped": q_divergence_loss_clipped,
    "divergence_loss_unclipped": q_divergence_loss_unclipped,
    "reverse_kl": q_reverse_kl,
    "token_entropy": q_token_entropy,
    "param_delta": q_param_delta,
    "update_sparsity": q_update_sparsity,
    "reported_tensors": q_reported_tensors,
    "overall_sparsity": q_overall_sparsity,
    "delta_rank": q_delta_rank,
    "blocked_sparsity": q_blocked_sparsity,
    "blocked_overlap": q_blocked_overlap,
    "blocked_rank": q_blocked_rank,
    "checkpoint_report": q_checkpoint_report,
    "update_mask": q_update_mask,
    "update_overlap": q_update_overlap,
    "grad_norm": q_grad_norm,
    "grad_sparsity": q_grad_sparsity,
    "grad_metrics": q_grad_metrics,
    "streaming_grad_metrics": q_streaming_grad_metrics,
    "run_catalogue": q_run_catalogue,
    "run_args": q_run_args,
    "pointer_files": q_pointer_files,
    "failure_reason": q_failure_reason,
    "run_logs": q_run_logs,
}

_r = lambda x, n=6: f"round(CAST({x} AS DOUBLE), {n}) + 0.0"
_EXCEPTION = r"^[A-Za-z_][A-Za-z0-9_.]*(\([A-Za-z0-9_]*\))?(:|$)"

# Deltas are multiples of 1/1024, so the rank is that of whole numbers: elimination modulo the prime
# 2**31 - 1, column by column, by cross multiplication with the first row that is not zero there.
_ELIMINATION = """steps AS (
  SELECT model, tensor, vec_id, list(CAST(d * 1024 AS BIGINT) ORDER BY i) AS v, false AS used, 1 AS c
  FROM deltas WHERE contains(tensor, 'mlp.down_proj.weight') OR contains(tensor, 'self_attn.v_proj.weight')
  GROUP BY model, tensor, vec_id
  UNION ALL
  SELECT model, tensor, vec_id,
    CASE WHEN top IS NULL OR vec_id = top THEN v
      ELSE list_transform(list_zip(v, top_v), lambda x: ((x[1] * top_v[c] - x[2] * v[c]) % 2147483647 + 2147483647) % 2147483647) END,
    used OR coalesce(vec_id = top, false), c + 1
  FROM (
    SELECT *, min(vec_id) FILTER (WHERE NOT used AND v[c] % 2147483647 <> 0) OVER w AS top,
      arg_min(v, vec_id) FILTER (WHERE NOT used AND v[c] % 2147483647 <> 0) OVER w AS top_v
    FROM steps WHERE c <= len(v) WINDOW w AS (PARTITION BY model, tensor)))
SELECT model, tensor, CAST(count(*) FILTER (WHERE used) AS INTEGER) AS rank,
  CAST(least(count(*), max(len(v))) AS INTEGER) AS max_rank
FROM steps WHERE c = len(v) + 1 GROUP BY model, tensor"""

ORACLES = {
    "log_softmax": f"""WITH {a.logprobs_sql(TEMPERATURE)}
SELECT vec_id, i, {_r('ls')} AS log_student, {_r('lt')} AS log_teacher FROM logprobs""",
    "log_mixture": f"""WITH {a.jsd_sql(BETA)}
SELECT vec_id, i, {_r('lm')} AS log_mixture FROM mixed""",
    "pointwise_jsd": f"""WITH {a.jsd_sql(clip=CLIP, masked=MASKED)}
SELECT vec_id, i, {_r('term')} AS term FROM terms""",
    "position_jsd": f"""WITH {a.jsd_sql(masked=MASKED)}
SELECT vec_id, seq_id, pos, {_r('sum(term)')} AS divergence FROM terms WHERE loss_mask GROUP BY vec_id, seq_id, pos""",
    "divergence_loss": f"""WITH {a.jsd_sql()}
SELECT seq_id, count(DISTINCT vec_id) AS tokens, {_r('sum(term) / 7')} AS loss FROM terms WHERE loss_mask GROUP BY seq_id""",
    "divergence_loss_clipped": f"""WITH {a.jsd_sql(BETA, CLIP, TEMPERATURE)}
SELECT count(DISTINCT vec_id) AS tokens, {_r('sum(term) / count(DISTINCT vec_id)')} AS loss FROM terms WHERE loss_mask""",
    "divergence_loss_unclipped": f"""WITH {a.jsd_sql(clip=None)}
SELECT count(DISTINCT vec_id) AS tokens, {_r('sum(term) / count(DISTINCT vec_id)')} AS loss FROM terms WHERE loss_mask""",
    "reverse_kl": f"""WITH {a.logprobs_sql()}
SELECT vec_id, seq_id, pos, {_r('sum(exp(ls) * (ls - lt))')} AS divergence FROM logprobs WHERE loss_mask GROUP BY vec_id, seq_id, pos""",
    "token_entropy": f"""WITH {a.logprobs_sql()}
SELECT vec_id, {_r('-sum(exp(ls) * ls)')} AS entropy FROM logprobs GROUP BY vec_id""",
    "param_delta": f"""WITH {a.PARAMS_SQL}
SELECT model, tensor, count(DISTINCT vec_id) AS rows, {_r('sum(CAST(d AS DOUBLE))')} AS total, {_r('max(abs(d))')} AS largest
FROM deltas GROUP BY model, tensor""",
    "update_sparsity": f"""WITH {a.PARAMS_SQL}
SELECT model, tensor, count(*) AS params, count(*) FILTER (WHERE abs(d) < 1e-5) AS unchanged,
  {_r('count(*) FILTER (WHERE abs(d) < 1e-5) / count(*)')} AS sparsity FROM deltas GROUP BY model, tensor""",
    "reported_tensors": f"""WITH {a.PARAMS_SQL}
SELECT model, tensor, count(*) AS params, {_r('count(*) FILTER (WHERE abs(d) < 1e-5) / count(*)')} AS sparsity
FROM deltas WHERE contains(tensor, 'mlp.down_proj.weight') OR contains(tensor, 'self_attn.v_proj.weight') GROUP BY model, tensor""",
    "overall_sparsity": f"""WITH {a.PARAMS_SQL}
SELECT model, count(*) AS params, count(*) FILTER (WHERE abs(d) < 1e-5) AS unchanged,
  {_r('count(*) FILTER (WHERE abs(d) < 1e-5) / count(*)')} AS sparsity FROM deltas GROUP BY model""",
    "delta_rank": f"""WITH RECURSIVE {a.PARAMS_SQL},
{_ELIMINATION}""",
    "update_mask": f"""WITH {a.PARAMS_SQL}
SELECT model, tensor, i, count(*) FILTER (WHERE abs(d) >= 1e-5) AS updated FROM deltas GROUP BY model, tensor, i""",
    "update_overlap": f"""WITH {a.PARAMS_SQL},
counts AS (
  SELECT x.model AS model_a, y.model AS model_b, count(*) FILTER (WHERE abs(x.d) >= 1e-5 AND abs(y.d) >= 1e-5) AS in_both,
    count(*) FILTER (WHERE abs(x.d) >= 1e-5 OR abs(y.d) >= 1e-5) AS in_either
  FROM deltas x JOIN deltas y ON x.m < y.m AND x.tensor = y.tensor AND x.vec_id = y.vec_id AND x.i = y.i GROUP BY x.model, y.model)
SELECT model_a, model_b, in_both, in_either, {_r('in_both / in_either')} AS overlap FROM counts""",
    "grad_norm": f"""WITH {a.GRADS_SQL}
SELECT step, name, {_r('sqrt(sum(grad * grad))', 9)} AS grad_norm FROM grads GROUP BY step, name""",
    "grad_sparsity": f"""WITH {a.GRADS_SQL}
SELECT step, name, {_r('avg(CAST(abs(grad) < 1e-6 AS INT))')} AS grad_sparsity FROM grads GROUP BY step, name""",
    "grad_metrics": f"""WITH {a.GRADS_SQL}
SELECT step, 'grad_norm/' || name AS metric, {_r('sqrt(sum(grad * grad))', 9)} AS value FROM grads GROUP BY step, name
UNION ALL SELECT step, 'grad_sparsity/' || name, {_r('avg(CAST(abs(grad) < 1e-6 AS INT))', 9)} FROM grads GROUP BY step, name""",
    "streaming_grad_metrics": f"""WITH {a.GRADS_SQL}
SELECT step, name, {_r('sqrt(sum(grad * grad))', 9)} AS grad_norm, {_r('avg(CAST(abs(grad) < 1e-6 AS INT))')} AS grad_sparsity,
  count(*) AS entries FROM grads GROUP BY step, name""",
    "run_catalogue": """SELECT event_type || '-' || (user_id % 8) AS run_id, CAST(count(*) AS DOUBLE) AS step, round(sum(value), 4) AS value,
  max(value) AS largest, 3 AS n_metrics, '{"last":' || max(event_id) || '}' AS nested
FROM events GROUP BY event_type || '-' || (user_id % 8)""",
    "run_args": """SELECT event_id, 3 AS n_flags, CAST(event_id AS VARCHAR) AS event, event_type AS type,
  CAST(user_id AS VARCHAR) AS user_id FROM events""",
    "pointer_files": """SELECT source, count(*) FILTER (WHERE doc_id % 10 = 0) AS pointers, count(*) AS files FROM documents GROUP BY source""",
    "failure_reason": f"""WITH {a.LOG_LINES_SQL},
kinds AS (
  SELECT *, CASE WHEN starts_with(value, 'Traceback (most recent call last):') THEN 'opens'
      WHEN regexp_full_match(value, '[ \t]*\r?') THEN 'blank' WHEN regexp_matches(value, '^[ \t]') THEN 'inner' ELSE 'other' END AS kind
  FROM log_lines),
priors AS (SELECT *, lag(kind) OVER (PARTITION BY run_id ORDER BY line_no) AS prior FROM kinds),
begun AS (
  SELECT *, kind = 'opens' OR kind = 'other' AND coalesce(prior NOT IN ('opens', 'inner'), true) AS begins FROM priors),
parts AS (SELECT *, count(*) FILTER (WHERE begins) OVER (PARTITION BY run_id ORDER BY line_no) AS part FROM begun),
opened AS (SELECT run_id, part FROM parts WHERE kind = 'opens')
SELECT run_id, arg_max(value, line_no) AS reason FROM parts JOIN opened USING (run_id, part)
WHERE kind = 'other' AND NOT begins AND regexp_matches(value, '{_EXCEPTION}') GROUP BY run_id""",
}

# The same results from rows that are cut into blocks.
ORACLES |= {
    "split_position_jsd": ORACLES["position_jsd"],
    "split_reverse_kl": ORACLES["reverse_kl"],
    "blocked_sparsity": ORACLES["update_sparsity"],
    "blocked_overlap": ORACLES["update_overlap"],
    "blocked_rank": ORACLES["delta_rank"],
    "checkpoint_report": f"""SELECT model, tensor, params, sparsity, rank, max_rank
FROM ({ORACLES['reported_tensors']}) JOIN ({ORACLES['delta_rank']}) USING (model, tensor)""",
    "run_logs": f"""WITH {a.LOG_LINES_SQL},
runs AS (SELECT 'r' || (run_id % 8) AS run_id, arg_max(run_id, run_id) AS last, count(*) AS lines FROM log_lines
  WHERE run_id % 8 % 3 <> 0 GROUP BY ALL)
SELECT r.run_id, lines, (SELECT arg_max(reason, x.run_id) FROM ({ORACLES['failure_reason']}) x
    WHERE 'r' || (x.run_id % 8) = r.run_id) AS reason, false AS pointer FROM runs r
UNION ALL SELECT 'r' || i, 1, NULL, true FROM range(8) t(i) WHERE i % 3 = 0""",
}
