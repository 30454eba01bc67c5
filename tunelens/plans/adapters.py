"""The tables the operators expect, derived from the driver tables.

Every adapter has a Spark form and the same rule as a DuckDB common table
expression, so that an oracle starts from the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelens.functions.common import int_div
from tunelens.functions.messages import message
from tunelens.functions.text import option_letter
from tunelens.operators.ordering import with_position
from tunelens.functions.divergence import entropy, token_log_probability
from tunelens.sources.tables import PARAM_COLUMNS

MODELS = 3
TOKEN_LIMIT = 1024
TUNED = ("m1", "m2", "m3")
BASE = "base"
VOCAB = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _suffixed(text: Column, k: Column) -> Column:
    """Append the answer ending number ``k`` of eight."""
    endings = {4: "\n#### 12", 5: "", 6: "\n##### 3", 7: "\n#### 2 because the premises say so"}
    ending = F.concat(F.lit("\n#### "), (k + 1).cast("string"))
    for value, text_value in endings.items():
        ending = F.when(k == value, F.lit(text_value)).otherwise(ending)
    return F.concat(text, ending)


def suffix_sql(text: str, k: str) -> str:
    return f"""{text} || CASE {k}
      WHEN 4 THEN chr(10) || '#### 12' WHEN 5 THEN '' WHEN 6 THEN chr(10) || '##### 3'
      WHEN 7 THEN chr(10) || '#### 2 because the premises say so'
      ELSE chr(10) || '#### ' || CAST({k} + 1 AS VARCHAR) END"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    return _replies(spark, sf_dir).select(
        conv.alias("prompt_id"),
        turn.alias("sample_id"),
        int_div(conv, 8).alias("step"),
        F.when(conv % 2 == 0, "validation").otherwise("test").alias("split"),
        F.concat(F.lit("m"), (turn % 3).cast("string")).alias("model"),
        _suffixed(text, (conv * 3 + turn) % 8).alias("response"),
        ((int_div(conv, 2) + turn) % 4 + 1).alias("correct_option"),
        F.length(text).cast("long").alias("n_tokens"),
        (conv % 50 + 10).alias("prompt_tokens"),
        ((conv + turn) % 5 != 0).alias("finished"),
    )


COMPLETIONS_SQL = f"""completions AS (
  SELECT conv_id AS prompt_id, turn AS sample_id, conv_id // 8 AS step,
    CASE WHEN conv_id % 2 = 0 THEN 'validation' ELSE 'test' END AS split,
    'm' || CAST(turn % 3 AS VARCHAR) AS model,
    {suffix_sql('text', '((conv_id * 3 + turn) % 8)')} AS response,
    (conv_id // 2 + turn) % 4 + 1 AS correct_option,
    length(text) AS n_tokens,
    conv_id % 50 + 10 AS prompt_tokens,
    (conv_id + turn) % 5 <> 0 AS finished
  FROM conversations WHERE role = 'assistant')"""

# Samples are named by (split, prompt_id, sample_id); a dense idx is added where it matters.
SAMPLE_KEYS = ("split", "prompt_id", "sample_id")


def samples(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    options = [
        F.concat(F.lit(f"Option {letter} of "), conv.cast("string")) for letter in "ABCD"
    ]
    # Every turn is a sample; only assistant turns have a response, so the others count as missing.
    rows = table(spark, sf_dir, "conversations").select(
        F.when(conv % 2 == 0, "validation").otherwise("test").alias("split"),
        conv.alias("prompt_id"),
        turn.alias("sample_id"),
        F.concat(F.lit("Context "), conv.cast("string")).alias("context"),
        F.col("text").alias("query"),
        F.array(*options).alias("options"),
        ((int_div(conv, 2) + turn) % 4).cast("int").alias("correct_option"),
    )
    if not dense:
        return rows
    return with_position(rows, ["prompt_id", "sample_id"], "idx", within=["split"], key=SAMPLE_KEYS)


SAMPLES_SQL = """samples AS (
  SELECT CASE WHEN conv_id % 2 = 0 THEN 'validation' ELSE 'test' END AS split,
    conv_id AS prompt_id, turn AS sample_id,
    'Context ' || CAST(conv_id AS VARCHAR) AS context, text AS query,
    (conv_id // 2 + turn) % 4 AS correct_option,
    row_number() OVER (PARTITION BY conv_id % 2 ORDER BY conv_id, turn) - 1 AS idx
  FROM conversations)"""


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models' responses; the last model answers nothing in every seventh conversation."""
    return reduce(DataFrame.unionAll, [responses_of(spark, sf_dir, m) for m in range(MODELS)])


def responses_of(spark: SparkSession, sf_dir: str, m: int) -> DataFrame:
    """One model's responses."""
    conv, turn = F.col("conv_id"), F.col("turn")
    replies = _replies(spark, sf_dir)
    return (replies if m < 2 else replies.filter(conv % 7 != 0)).select(
        F.lit(f"m{m}").alias("model"),
        F.when(conv % 2 == 0, "validation").otherwise("test").alias("split"),
        conv.alias("prompt_id"),
        turn.alias("sample_id"),
        _suffixed(F.col("text"), (conv * 3 + turn + m) % 8).alias("response"),
    )


MODEL_RESPONSES_SQL = f"""model_responses AS (
  SELECT 'm' || CAST(m AS VARCHAR) AS model,
    CASE WHEN conv_id % 2 = 0 THEN 'validation' ELSE 'test' END AS split,
    conv_id AS prompt_id, turn AS sample_id,
    {suffix_sql('text', '((conv_id * 3 + turn + m) % 8)')} AS response
  FROM conversations, range({MODELS}) r(m)
  WHERE role = 'assistant' AND (m < 2 OR conv_id % 7 <> 0))"""


def document_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as responses."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        (doc % 4 + 1).alias("correct_option"),
        _suffixed(F.col("text"), doc % 8).alias("response"),
    )


DOCUMENT_RESPONSES_SQL = f"""document_responses AS (
  SELECT doc_id, lang, source, doc_id % 4 + 1 AS correct_option,
    {suffix_sql('text', '(doc_id % 8)')} AS response
  FROM documents)"""


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message list per conversation; every fifth has no label, every third no source.

    A conversation's turns are one message list by definition of the data.
    """
    conv = F.col("conv_id")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    return turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"),
        F.when(conv % 5 < 4, option_letter((conv % 5).cast("int"))).otherwise("").alias("label"),
        F.when(conv % 3 != 0, F.concat(F.lit("set"), (conv % 3).cast("string"))).alias("datasource"),
    )


CHAT_ROWS_SQL = """chat_rows AS (
  SELECT conv_id, CASE WHEN conv_id % 5 < 4 THEN chr(CAST(65 + conv_id % 5 AS INT)) ELSE '' END AS label,
    CASE WHEN conv_id % 3 <> 0 THEN 'set' || CAST(conv_id % 3 AS VARCHAR) END AS datasource,
    string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) AS body,
    bool_or(role = 'system') AS has_system,
    min(CASE WHEN role = 'system' THEN turn END) AS system_turn
  FROM conversations GROUP BY conv_id)"""


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, lines): eight raw lines per benchmark item."""
    item = F.col("item_id")
    letter = F.substring(F.lit("abcd"), (item % 4 + 1).cast("int"), F.lit(1))
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    options = [F.concat(F.lit(f"{o}.{i} option of "), item.cast("string")) for i, o in enumerate("ABCD")]
    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.array(F.lit(""), letter, text, F.lit("Which holds?"), *options).alias("lines")
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as numbered lines of one file."""
    return raw_records(spark, sf_dir).select("item_id", F.posexplode("lines").alias("slot", "value")).select(
        F.lit("benchmark").alias("file"), (F.col("item_id") * 8 + F.col("slot")).alias("line_no"), "value"
    )


def norm_sql(text: str) -> str:
    """A sentence closed piece by piece: split, filter, join."""
    joined = f"""array_to_string(list_transform(
        list_filter(string_split(replace({text}, chr(10), ''), '.'), lambda p: p <> ''),
        lambda p, i: CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^\\p{{N}}') THEN '.' || p ELSE '. ' || p END), '')"""
    plain = f"""rtrim(replace(replace({joined}, '  ', ' '), chr(92) || '''', ''''), e' \\t\\n\\r\\x0b\\x0c')"""
    closed = f"""(SELECT CASE WHEN regexp_matches(q, '^[A-Z][\\p{{L}}\\p{{N}}_\\s]+[?.!]$') THEN q ELSE q || '.' END FROM (SELECT {plain} AS q))"""
    return f"replace(replace(replace({closed}, '?.', '?'), '!.', '!'), '..', '.')"


RAW_RECORDS_SQL = """raw_records AS (
  SELECT item_id, substr('abcd', CAST(item_id % 4 + 1 AS INT), 1) AS letter,
    replace(text, chr(10), ' ') AS context, 'Which holds?' AS query,
    ['A.0 option of ' || item_id, 'B.1 option of ' || item_id,
     'C.2 option of ' || item_id, 'D.3 option of ' || item_id] AS options
  FROM benchmark)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as student, its successor as teacher."""
    vectors = table(spark, sf_dir, "embeddings")
    student = vectors.select("vec_id", F.col("embedding").alias("student_logits"))
    teacher = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("teacher_logits"))
    vec = F.col("vec_id")
    return student.join(teacher, "vec_id").select(
        "vec_id",
        int_div(vec, 10).alias("seq_id"),
        (vec % 10).cast("int").alias("pos"),
        (vec % 10 >= 3).alias("loss_mask"),
        "student_logits",
        "teacher_logits",
    )


LOGITS_SQL = """logits AS (
  SELECT a.vec_id, a.vec_id // 10 AS seq_id, a.vec_id % 10 AS pos, a.vec_id % 10 >= 3 AS loss_mask,
    a.embedding AS s, b.embedding AS t
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
cells AS (
  SELECT vec_id, seq_id, pos, loss_mask, CAST(i AS INT) AS i, CAST(s AS DOUBLE) AS s, CAST(t AS DOUBLE) AS t
  FROM (SELECT vec_id, seq_id, pos, loss_mask, unnest(range(len(s))) AS i, unnest(s) AS s, unnest(t) AS t FROM logits))"""


def logprobs_sql(temperature: float = 1.0) -> str:
    return f"""{LOGITS_SQL},
scaled AS (SELECT vec_id, seq_id, pos, loss_mask, i, s / {temperature} AS s, t / {temperature} AS t FROM cells),
peaks AS (SELECT vec_id, max(s) AS ms, max(t) AS mt FROM scaled GROUP BY vec_id),
sums AS (
  SELECT vec_id, any_value(ms) + ln(sum(exp(s - ms))) AS zs, any_value(mt) + ln(sum(exp(t - mt))) AS zt
  FROM scaled JOIN peaks USING (vec_id) GROUP BY vec_id),
logprobs AS (
  SELECT vec_id, seq_id, pos, loss_mask, i, s - zs AS ls, t - zt AS lt FROM scaled JOIN sums USING (vec_id))"""


def jsd_sql(beta: float = 0.5, clip: float | None = 10.0, temperature: float = 1.0, masked: tuple[int, ...] = ()) -> str:
    cap = (lambda x: f"least({x}, {clip})") if clip else (lambda x: x)
    term = f"{beta} * {cap('exp(lt) * (lt - lm)')} + {1 - beta} * {cap('exp(ls) * (ls - lm)')}"
    if masked:
        term = f"CASE WHEN i IN ({', '.join(map(str, masked))}) THEN 0 ELSE {term} END"
    return f"""{logprobs_sql(temperature)},
mixed AS (SELECT *, ln({beta} * exp(lt) + {1 - beta} * exp(ls)) AS lm FROM logprobs),
terms AS (SELECT vec_id, seq_id, pos, loss_mask, i, {term} AS term FROM mixed)"""


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base and three tuned models over the vectors, one tensor per label.

    Each model is a branch of its own, so a filter on models leaves only their
    branches.
    """
    label, vec = F.col("label"), F.col("vec_id")
    tensor = (
        F.when(label == 9, F.lit("embed.weight"))
        .when(label % 2 == 0, F.concat(F.lit("layers."), label.cast("string"), F.lit(".mlp.down_proj.weight")))
        .otherwise(F.concat(F.lit("layers."), label.cast("string"), F.lit(".self_attn.v_proj.weight")))
    )
    vectors = table(spark, sf_dir, "embeddings")
    rows = with_position(vectors, ["vec_id"], "row_idx", within=["label"], key=["vec_id"])
    sizes = vectors.groupBy("label").agg(F.count("*").cast("int").alias("n_rows"))
    sized = rows.join(sizes, "label")

    def model(m: int) -> DataFrame:
        def value(x: Column, i: Column) -> Column:
            ground = F.floor(x.cast("double") * 1024) / 1024
            if m == 0:
                return ground.cast("float")
            moved = (vec * 31 + i * 7 + m) % 10 < 2
            return (ground + F.when(moved, F.lit(1.0 / 1024)).otherwise(0.0)).cast("float")

        return sized.select(
            F.lit(TUNED[m - 1] if m else BASE).alias("model"),
            tensor.alias("tensor"),
            F.array(F.col("n_rows"), F.size("embedding")).alias("shape"),
            "row_idx",
            F.transform("embedding", value).alias("values"),
        ).select(*PARAM_COLUMNS)

    return reduce(DataFrame.unionAll, [model(m) for m in range(len(TUNED) + 1)])


PARAMS_SQL = """params AS (
  SELECT m, CASE WHEN label = 9 THEN 'embed.weight'
      WHEN label % 2 = 0 THEN 'layers.' || label || '.mlp.down_proj.weight'
      ELSE 'layers.' || label || '.self_attn.v_proj.weight' END AS tensor,
    vec_id, i, CAST(floor(CAST(x AS DOUBLE) * 1024) / 1024
      + CASE WHEN m > 0 AND (vec_id * 31 + i * 7 + m) % 10 < 2 THEN 1.0 / 1024 ELSE 0 END AS FLOAT) AS v
  FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings), range(4) r(m)),
deltas AS (
  SELECT 'm' || t.m AS model, t.m, t.tensor, t.vec_id, t.i, t.v - b.v AS d
  FROM params t JOIN params b ON b.m = 0 AND t.m > 0 AND b.tensor = t.tensor AND b.vec_id = t.vec_id AND b.i = t.i)"""


def sampled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token log probabilities: the student as trainer, the teacher as sampler."""
    vec = F.col("vec_id")
    token = (vec * 7 % VOCAB).cast("int")
    return logits(spark, sf_dir).select(
        int_div(F.col("seq_id"), 4).alias("step"),
        (F.col("seq_id") % 4).alias("worker"),
        "seq_id",
        "pos",
        token_log_probability(F.col("student_logits"), token).alias("logp_train"),
        token_log_probability(F.col("teacher_logits"), token).alias("logp_sampler"),
        (vec % 3 - 1).cast("double").alias("advantage"),
        entropy(F.col("student_logits")).alias("entropy"),
    )


TOKENS_SQL = f"""{logprobs_sql()},
tokens AS (
  SELECT seq_id // 4 AS step, seq_id % 4 AS worker, seq_id, pos,
    max(CASE WHEN i = vec_id * 7 % {VOCAB} THEN ls - lt END) AS gap,
    vec_id % 3 - 1 AS advantage, -sum(exp(ls) * ls) AS entropy
  FROM logprobs GROUP BY vec_id, seq_id, pos)"""


def grads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        int_div(F.col("event_id"), 1000).alias("step"),
        F.col("event_type").alias("name"),
        (F.col("value") * 1e-7).alias("grad"),
    )


GRADS_SQL = """grads AS (
  SELECT event_id // 1000 AS step, event_type AS name, value * 1e-7 AS grad FROM events)"""


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds per phase of each run: events of a user; further kinds keep their names."""
    names = {"click": "rollout_time", "view": "teacher_fwd_time", "purchase": "student_train_time"}
    phase = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.coalesce(F.try_element_at(phase, kind), kind).alias("phase"),
        F.col("value").alias("seconds"),
    )


PHASES_SQL = """phases AS (
  SELECT user_id AS run_id, CASE event_type WHEN 'click' THEN 'rollout_time' WHEN 'view' THEN 'teacher_fwd_time'
      WHEN 'purchase' THEN 'student_train_time' ELSE event_type END AS phase, value AS seconds
  FROM events)"""


_FRAME = "Traceback (most recent call last):\n  File \"run.py\", line 1, in fit\n    step()\n"
_LOGGED = "ValueError: only logged"
_AGAIN = "\n\nDuring handling of the above exception, another exception occurred:\n\n"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a run's log; two of three end in a traceback, one of them chained and with a cause."""
    doc = F.col("doc_id").cast("string")
    plain = F.concat(F.lit(f"\n{_LOGGED}\n{_FRAME}ValueError: bad value "), doc, F.lit(f"\nstopping\n{_LOGGED}"))
    chained = F.concat(
        F.lit(f"\n{_FRAME}KeyError: 'x'{_AGAIN}{_FRAME}lib.TaskError(OutOfMemoryError): run "), doc,
        F.lit("\n           ^^^^\n  File \"step.py\", line 2\nlib.OutOfMemory: of "), doc,
    )
    end = F.when(F.col("doc_id") % 3 == 0, plain).when(F.col("doc_id") % 3 == 1, chained).otherwise(f"\n{_LOGGED}")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("run_id"),
        F.posexplode(F.split(F.concat(F.col("text"), end), "\n")).alias("line_no", "value"),
    )


def _sql_text(text: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


LOG_LINES_SQL = f"""logs AS (
  SELECT doc_id AS run_id, string_split(text || CASE doc_id % 3
      WHEN 0 THEN {_sql_text(chr(10) + _LOGGED + chr(10) + _FRAME + "ValueError: bad value ")} || doc_id
        || {_sql_text(chr(10) + "stopping" + chr(10) + _LOGGED)}
      WHEN 1 THEN {_sql_text(chr(10) + _FRAME + "KeyError: 'x'" + _AGAIN + _FRAME + "lib.TaskError(OutOfMemoryError): run ")} || doc_id
        || {_sql_text(chr(10) + "           ^^^^" + chr(10) + '  File "step.py", line 2' + chr(10) + "lib.OutOfMemory: of ")} || doc_id
      ELSE {_sql_text(chr(10) + _LOGGED)} END, chr(10)) AS lines FROM documents),
log_lines AS (SELECT run_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS value FROM logs)"""
