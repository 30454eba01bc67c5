"""Registered queries: answers, scorecards, rewards and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelens.functions.rewards import REWARDS, correctness
from tunelens.functions.text import extract_answer, same_number, word_count
from tunelens.operators.evaluation import align, audit_rows, classify, compare_models, scorecard
from tunelens.operators.reward_table import advantage, debug_first, total_reward, with_rewards
from tunelens.operators.rollups import length_rollup, phase_rollup, reward_rollup, sampling_rollup
from tunelens.plans import adapters as a
from tunelens.session import materialise

KEYS = a.SAMPLE_KEYS


def rounded(column: str, digits: int = 6) -> Column:
    """Rounded, with minus zero folded into zero."""
    return (F.round(F.col(column), digits) + F.lit(0.0)).alias(column)


def one_model(spark: SparkSession, sf_dir: str, model: str = "m0") -> DataFrame:
    return a.responses_of(spark, sf_dir, int(model.removeprefix("m"))).drop("model")


def q_extract_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.document_responses(spark, sf_dir).select("doc_id", extract_answer(F.col("response")).alias("answer"))


def q_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = a.samples(spark, sf_dir).select(*KEYS, "correct_option")
    aligned = align(keyed, one_model(spark, sf_dir, "m2"), KEYS)
    return aligned.select(
        *KEYS, F.coalesce("responded", F.lit(False)).alias("responded"), F.length("response").alias("n_chars")
    )


def q_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = a.samples(spark, sf_dir).select(*KEYS, "correct_option")
    scored = classify(align(keyed, one_model(spark, sf_dir), KEYS))
    return scored.select(*KEYS, "answer", "outcome")


def q_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = scorecard(a.samples(spark, sf_dir), one_model(spark, sf_dir), KEYS)
    return card.select("split", "total", "correct", "wrong", "no_answer", rounded("accuracy"), rounded("pct_passed"))


def q_scorecard_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = scorecard(a.samples(spark, sf_dir), one_model(spark, sf_dir), KEYS, combined=True)
    return card.select("split", "total", "correct", "wrong", "no_answer", rounded("accuracy"), rounded("pct_passed"))


def q_scorecard_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = scorecard(a.samples(spark, sf_dir), one_model(spark, sf_dir, "m2"), KEYS)
    return card.select("split", "total", "correct", "wrong", "no_answer", rounded("accuracy"))


def q_compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = compare_models(a.samples(spark, sf_dir), a.model_responses(spark, sf_dir), on=KEYS, combined=True)
    return card.select("model", "split", "total", "correct", "wrong", "no_answer", rounded("accuracy"))


def q_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = a.samples(spark, sf_dir, dense=True)
    keyed = samples.select("split", "idx", "prompt_id", "sample_id")
    responses = one_model(spark, sf_dir).join(keyed, list(KEYS)).select("split", "idx", "response")
    return audit_rows(samples, responses)


def q_integer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer against string comparison of zero-padded answers."""
    padded = F.concat(F.col("text"), F.lit("\n#### "), F.repeat(F.lit("0"), (F.col("doc_id") % 3).cast("int")), F.lit("2"))
    docs = a.table(spark, sf_dir, "documents").select("doc_id", padded.alias("response"), (F.col("doc_id") % 4 + 1).alias("key"))
    answer = extract_answer(F.col("response"))
    return docs.select(
        "doc_id",
        same_number(answer, F.col("key")).alias("same_number"),
        correctness(F.col("response"), F.col("key")).alias("correctness"),
    )


def _graded(df: DataFrame) -> DataFrame:
    return total_reward(with_rewards(df))


def _round_rewards(*extra: str) -> list[Column]:
    return [rounded(c) for c in (*REWARDS, *extra)]


def q_rewards_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(a.document_responses(spark, sf_dir)).select("doc_id", *_round_rewards("reward"))


def q_rewards_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(a.completions(spark, sf_dir)).select("prompt_id", "sample_id", *_round_rewards("reward"))


def q_weighted_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own reward beside two built-in ones, with weights."""
    brevity = lambda response, key: F.when(word_count(response) <= 200, 1.0).otherwise(0.0)
    chosen = {"correctness": REWARDS["correctness"], "format": REWARDS["format"], "brevity": brevity}
    graded = total_reward(with_rewards(a.document_responses(spark, sf_dir), chosen), list(chosen), [1.0, 0.5, 2.0])
    return graded.select("doc_id", rounded("brevity"), rounded("reward"))


def q_debug_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = with_rewards(a.completions(spark, sf_dir), {"correctness": correctness})
    batched = graded.select(
        F.col("step").alias("batch"),
        F.struct("prompt_id", "sample_id").alias("pos"),
        F.concat(F.lit("Question "), F.col("prompt_id").cast("string")).alias("question"),
        "response",
        "correct_option",
        F.col("correctness").alias("reward"),
    )
    return debug_first(batched)


def q_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once and narrow: the statistics and the rows both need the rewards,
    # and grading the texts twice would cost far more.
    graded = materialise(_graded(a.completions(spark, sf_dir)).select("prompt_id", "sample_id", "reward"))
    return advantage(graded).select("prompt_id", "sample_id", rounded("reward"), rounded("advantage", 5))


def q_reward_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = materialise(_graded(a.completions(spark, sf_dir)).select("step", "prompt_id", *REWARDS, "reward"))
    return reward_rollup(graded).select("step", "metric", rounded("value"))


def q_length_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = length_rollup(a.completions(spark, sf_dir), a.TOKEN_LIMIT, run=["model"])
    return rolled.select("model", "step", "metric", rounded("value"))


def q_sampling_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling_rollup(a.sampled_tokens(spark, sf_dir)).select("step", "metric", rounded("value"))


def q_phase_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phase_rollup(a.phases(spark, sf_dir)).select(
        "run_id", "phase", rounded("mean_seconds"), rounded("total_seconds"), rounded("share")
    )


QUERIES = {
    "extract_answer": q_extract_answer,
    "align_responses": q_align,
    "classify_outcomes": q_classify,
    "scorecard": q_scorecard,
    "scorecard_combined": q_scorecard_combined,
    "scorecard_missing_responses": q_scorecard_missing,
    "compare_models": q_compare_models,
    "audit_rows": q_audit_rows,
    "integer_and_string_compare": q_integer_compare,
    "rewards_documents": q_rewards_documents,
    "rewards_completions": q_rewards_completions,
    "weighted_reward": q_weighted_reward,
    "debug_first": q_debug_first,
    "advantage": q_advantage,
    "reward_rollup": q_reward_rollup,
    "length_rollup": q_length_rollup,
    "sampling_rollup": q_sampling_rollup,
    "phase_rollup": q_phase_rollup,
}

_WS = r"e' \t\n\r\x0b\x0c'"


def answer_sql(text: str) -> str:
    digits = f"regexp_extract(trim(list_last(string_split({text}, '####')), {_WS}), '^[0-9]+')"
    return f"CASE WHEN contains({text}, '####') AND {digits} <> '' THEN {digits} END"


def outcome_sql(answer: str, key: str) -> str:
    return f"""CASE WHEN {answer} IS NULL THEN 'no_answer' WHEN CAST({answer} AS HUGEINT) = {key} THEN 'correct' ELSE 'wrong' END"""


def rewards_sql(response: str = "response") -> str:
    """Five reward columns over a relation with ``response`` and ``correct_option``."""
    r = response
    trailing = f"trim(list_last(string_split({r}, '####')), {_WS})"
    pieces = f"string_split_regex(trim(string_split({r}, '####')[1], {_WS}), '[.!?\\n]')"
    sentences = f"len(list_filter({pieces}, lambda x: length(trim(x, {_WS})) > 10))"
    words = f"string_split_regex(trim({r}, {_WS}), '\\s+')"
    trigrams = "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
    return f"""
      CASE WHEN answer = CAST(correct_option AS VARCHAR) THEN 2.0 ELSE 0.0 END AS correctness,
      CASE WHEN regexp_matches(trim({r}, {_WS}), '####\\s*[0-9]\\s*$') THEN 1.0
        WHEN contains({r}, '####') THEN 0.3 ELSE 0.0 END AS format,
      CASE WHEN answer IN ('1', '2', '3', '4') THEN 0.5 WHEN answer IS NOT NULL THEN 0.1 ELSE 0.0 END AS int_answer,
      (SELECT CASE WHEN len(w) < 10 THEN 0.0
          WHEN len(list_distinct({trigrams})) / (len(w) - 2) > 0.7 THEN 0.5
          WHEN len(list_distinct({trigrams})) / (len(w) - 2) > 0.4 THEN 0.2 ELSE -0.5 END
        FROM (SELECT {words} AS w)) AS no_repetition,
      CASE WHEN length(trim({r}, {_WS})) < 100 THEN -2.0 ELSE
        CASE WHEN {sentences} >= 5 THEN 0.5 WHEN {sentences} >= 3 THEN 0.3 WHEN {sentences} >= 1 THEN 0.1 ELSE 0.0 END
        + CASE WHEN NOT contains({r}, '####') THEN 0.0 WHEN regexp_matches({trailing}, '^[0-9]$') THEN 0.25
            WHEN length({trailing}) > 10 THEN -0.1 ELSE 0.0 END END AS reasoning_quality"""


def graded_sql(source: str, cte: str, keep: str) -> str:
    return f"""WITH {cte},
answered AS (SELECT *, {answer_sql('response')} AS answer FROM {source}),
graded AS (SELECT {keep}, {rewards_sql()} FROM answered),
rewarded AS (SELECT *, correctness + format + int_answer + no_repetition + reasoning_quality AS reward FROM graded)"""


def rounds(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) + 0.0 AS {n}" for n in names)


def scored_sql(model: str) -> str:
    return f"""WITH {a.SAMPLES_SQL}, {a.MODEL_RESPONSES_SQL},
answered AS (SELECT *, {answer_sql('response')} AS answer FROM model_responses WHERE model = '{model}'),
scored AS (
  SELECT s.*, r.response, r.answer, r.response IS NOT NULL AS responded,
    CASE WHEN r.response IS NOT NULL THEN {outcome_sql('r.answer', 's.correct_option + 1')} END AS outcome
  FROM samples s LEFT JOIN answered r USING (split, prompt_id, sample_id))"""


_COUNTS = """count(*) AS total, count(*) FILTER (WHERE outcome = 'correct') AS correct,
  count(*) FILTER (WHERE outcome = 'wrong') AS wrong, count(*) FILTER (WHERE outcome = 'no_answer') AS no_answer"""
_RATE = "round(CASE WHEN total > 0 THEN correct / total * 100 ELSE 0 END, 6)"
_CARD = f"split, total, correct, wrong, no_answer, {_RATE} AS accuracy"
_REWARD_NAMES = ("correctness", "format", "int_answer", "no_repetition", "reasoning_quality")


def _rollup(by: str, source: str) -> str:
    long = f"FROM ({source}) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE ({by}))))"
    return f"SELECT {by}, metric, round(CAST(value AS DOUBLE), 6) + 0.0 AS value {long}"


_REWARD_STATS = ", ".join(
    f"avg({n}) AS \"rewards/{n}/mean\", stddev_samp({n}) AS \"rewards/{n}/std\"" for n in _REWARD_NAMES
)

ORACLES = {
    "extract_answer": f"WITH {a.DOCUMENT_RESPONSES_SQL} SELECT doc_id, {answer_sql('response')} AS answer FROM document_responses",
    "align_responses": f"""{scored_sql('m2')}
SELECT split, prompt_id, sample_id, responded, length(response) AS n_chars FROM scored""",
    "classify_outcomes": f"""{scored_sql('m0')}
SELECT split, prompt_id, sample_id, answer, outcome FROM scored""",
    "scorecard": f"""{scored_sql('m0')}
SELECT {_CARD}, accuracy AS pct_passed FROM (SELECT split, {_COUNTS} FROM scored GROUP BY split)""",
    "scorecard_combined": f"""{scored_sql('m0')}
SELECT {_CARD}, accuracy AS pct_passed FROM (
  SELECT coalesce(split, 'combined') AS split, {_COUNTS} FROM scored GROUP BY ROLLUP (split))""",
    "scorecard_missing_responses": f"""{scored_sql('m2')}
SELECT {_CARD} FROM (SELECT split, {_COUNTS} FROM scored GROUP BY split)""",
    "compare_models": f"""WITH {a.SAMPLES_SQL}, {a.MODEL_RESPONSES_SQL},
answered AS (SELECT *, {answer_sql('response')} AS answer FROM model_responses),
scored AS (
  SELECT m.model, s.split, CASE WHEN r.response IS NOT NULL THEN {outcome_sql('r.answer', 's.correct_option + 1')} END AS outcome
  FROM samples s CROSS JOIN (SELECT DISTINCT model FROM answered) m
  LEFT JOIN answered r ON r.model = m.model AND r.split = s.split AND r.prompt_id = s.prompt_id AND r.sample_id = s.sample_id)
SELECT model, {_CARD} FROM (
  SELECT model, coalesce(split, 'combined') AS split, {_COUNTS} FROM scored GROUP BY GROUPING SETS ((model, split), (model)))""",
    "audit_rows": f"""{scored_sql('m0')}
SELECT split, idx, substr(query, 1, 200) AS question, correct_option + 1 AS truth, answer, outcome = 'correct' AS is_correct,
  right(response, 300) AS response_tail FROM scored WHERE responded AND (idx < 3 OR outcome = 'wrong')""",
    "integer_and_string_compare": f"""WITH padded AS (
  SELECT doc_id, text || chr(10) || '#### ' || repeat('0', CAST(doc_id % 3 AS INT)) || '2' AS response, doc_id % 4 + 1 AS key FROM documents)
SELECT doc_id, CAST({answer_sql('response')} AS HUGEINT) = key AS same_number,
  CASE WHEN {answer_sql('response')} = CAST(key AS VARCHAR) THEN CAST(2.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS correctness FROM padded""",
    "rewards_documents": f"""{graded_sql('document_responses', a.DOCUMENT_RESPONSES_SQL, 'doc_id')}
SELECT doc_id, {rounds(*_REWARD_NAMES, 'reward')} FROM rewarded""",
    "rewards_completions": f"""{graded_sql('completions', a.COMPLETIONS_SQL, 'prompt_id, sample_id')}
SELECT prompt_id, sample_id, {rounds(*_REWARD_NAMES, 'reward')} FROM rewarded""",
    "weighted_reward": f"""{graded_sql('document_responses', a.DOCUMENT_RESPONSES_SQL, 'doc_id, response')},
brief AS (SELECT *, CASE WHEN len(string_split_regex(trim(response, {_WS}), '\\s+')) <= 200 THEN 1.0 ELSE 0.0 END AS brevity FROM graded)
SELECT doc_id, CAST(brevity AS DOUBLE) AS brevity, round(CAST(correctness + 0.5 * format + 2 * brevity AS DOUBLE), 6) AS reward FROM brief""",
    "debug_first": f"""{graded_sql('completions', a.COMPLETIONS_SQL, 'step, prompt_id, sample_id, response, correct_option, answer')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY prompt_id, sample_id) AS place FROM graded)
SELECT step AS batch, 'Question ' || prompt_id AS question, correct_option AS key, right(response, 300) AS response_tail,
  answer, CAST(correctness AS DOUBLE) AS reward FROM ranked WHERE place = 1""",
    "advantage": f"""{graded_sql('completions', a.COMPLETIONS_SQL, 'prompt_id, sample_id')},
stats AS (SELECT prompt_id, avg(CAST(reward AS DOUBLE)) AS mu, coalesce(stddev_samp(CAST(reward AS DOUBLE)), 0) AS sd FROM rewarded GROUP BY prompt_id)
SELECT prompt_id, sample_id, round(CAST(reward AS DOUBLE), 6) + 0.0 AS reward, round((CAST(reward AS DOUBLE) - mu) / (sd + 1e-4), 5) + 0.0 AS advantage
FROM rewarded JOIN stats USING (prompt_id)""",
    "reward_rollup": f"""{graded_sql('completions', a.COMPLETIONS_SQL, 'step, prompt_id')},
flat AS (SELECT step, prompt_id, max(reward) = min(reward) AS flat FROM rewarded GROUP BY step, prompt_id),
stats AS (SELECT step, {_REWARD_STATS}, avg(reward) AS reward, stddev_samp(reward) AS reward_std FROM rewarded GROUP BY step)
{_rollup('step', 'SELECT * FROM stats')}
UNION ALL SELECT step, 'frac_reward_zero_std', round(avg(CAST(flat AS INT)), 6) FROM flat GROUP BY step""",
    "length_rollup": f"""WITH {a.COMPLETIONS_SQL},
stats AS (SELECT model, step, avg(n_tokens) AS "completions/mean_length", CAST(min(n_tokens) AS DOUBLE) AS "completions/min_length",
  CAST(max(n_tokens) AS DOUBLE) AS "completions/max_length",
  avg(n_tokens) FILTER (WHERE finished) AS "completions/mean_terminated_length",
  CAST(min(n_tokens) FILTER (WHERE finished) AS DOUBLE) AS "completions/min_terminated_length",
  CAST(max(n_tokens) FILTER (WHERE finished) AS DOUBLE) AS "completions/max_terminated_length",
  avg(CASE WHEN NOT finished AND n_tokens >= {a.TOKEN_LIMIT} THEN 1.0 ELSE 0.0 END) AS "completions/clipped_ratio",
  avg(n_tokens) AS response_length, avg(n_tokens + prompt_tokens) AS total_length,
  CAST(sum(sum(n_tokens + prompt_tokens)) OVER (PARTITION BY model ORDER BY step) AS DOUBLE) AS num_tokens
  FROM completions GROUP BY model, step)
{_rollup('model, step', 'SELECT * FROM stats')}""",
    "sampling_rollup": f"""WITH {a.TOKENS_SQL},
flags AS (SELECT *, exp(gap) < 0.8 AND advantage < 0 AS low, exp(gap) > 1.2 AND advantage > 0 AS high FROM tokens),
seqs AS (SELECT step, worker, seq_id, exp(sum(gap)) AS ratio FROM flags GROUP BY step, worker, seq_id),
workers AS (SELECT step, worker, avg(CAST(low AS INT)) AS low, avg(CAST(high AS INT)) AS high FROM flags GROUP BY step, worker),
stats AS (
  SELECT step, avg(abs(gap)) AS "sampling/sampling_logp_difference/mean", max(abs(gap)) AS "sampling/sampling_logp_difference/max",
    avg(CAST(low AS INT)) AS "clip_ratio/low_mean", avg(CAST(high AS INT)) AS "clip_ratio/high_mean",
    avg(CAST(low OR high AS INT)) AS "clip_ratio/region_mean", avg(entropy) AS entropy FROM flags GROUP BY step),
ratios AS (
  SELECT step, min(ratio) AS "sampling/importance_sampling_ratio/min", avg(ratio) AS "sampling/importance_sampling_ratio/mean",
    max(ratio) AS "sampling/importance_sampling_ratio/max" FROM seqs GROUP BY step),
bounds AS (SELECT step, min(low) AS "clip_ratio/low_min", max(high) AS "clip_ratio/high_max" FROM workers GROUP BY step)
{_rollup('step', 'SELECT * FROM stats JOIN ratios USING (step) JOIN bounds USING (step)')}""",
    "phase_rollup": f"""WITH {a.PHASES_SQL},
totals AS (SELECT run_id, phase, avg(seconds) AS mean_seconds, sum(seconds) AS total_seconds FROM phases GROUP BY run_id, phase)
SELECT run_id, phase, round(mean_seconds, 6) AS mean_seconds, round(total_seconds, 6) AS total_seconds,
  round(total_seconds / sum(total_seconds) OVER (PARTITION BY run_id), 6) AS share FROM totals""",
}
