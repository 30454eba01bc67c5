"""Prompt tables built from samples and chat rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelens.functions.messages import (
    EVAL_SYSTEM,
    TRAINING_SYSTEM,
    ChatTemplate,
    apply_template,
    eval_messages,
    has_label,
    message,
    render,
    training_messages,
    with_privilege,
    with_privilege_text,
)
from tunelens.functions.text import label_to_option, option_letter, word_count

# The prompt length limit and the source name of unnamed rows.
PROMPT_LIMIT = 2048
DEFAULT_DATASOURCE = "default"

Counter = Callable[[Column], Column]


def training_prompt(samples: DataFrame, system: str = TRAINING_SYSTEM) -> DataFrame:
    """Add ``prompt`` (system and user message, lettered options) and the ``answer`` letter."""
    return samples.withColumns(
        {
            "prompt": training_messages(F.col("context"), F.col("query"), F.col("options"), system),
            "answer": option_letter(F.col("correct_option")),
        }
    )


def eval_prompt(samples: DataFrame, system: str = EVAL_SYSTEM) -> DataFrame:
    """Add ``prompt`` with numbered options."""
    return samples.withColumn("prompt", eval_messages(F.col("context"), F.col("query"), F.col("options"), system))


def reward_input(chat_rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(prompt, correct_option) with the label letter as a 1-based option; null without a label."""
    option = F.when(F.trim("label") != "", label_to_option(F.col("label")))
    return chat_rows.select(
        *keep, F.col("messages").alias("prompt"), option.alias("correct_option")
    )


def paired_prompts(
    chat_rows: DataFrame,
    template: ChatTemplate | None = ChatTemplate(),
    input_template: str | None = None,
    counter: Counter = word_count,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Student and teacher prompt side by side; only the teacher sees the label.

    With a chat template the teacher is asked for a reply only when it was given
    no answer. Without one, ``messages`` is taken as plain text.
    """
    messages, label = F.col("messages"), F.col("label")
    if template is None:
        student = apply_template(messages, input_template)
        teacher = with_privilege_text(student, label)
    else:
        student = render(messages, template)
        teacher = render(with_privilege(messages, label), template, ~has_label(label))
    datasource = F.col("datasource") if "datasource" in chat_rows.columns else F.lit(None).cast("string")
    return chat_rows.select(
        *keep,
        student.alias("stu_prompt"),
        teacher.alias("tea_prompt"),
        student.alias("prompt"),
        counter(student).cast("int").alias("prompt_len"),
        F.coalesce(label.cast("string"), F.lit("")).alias("label"),
        F.coalesce(datasource, F.lit(DEFAULT_DATASOURCE)).alias("datasource"),
    )


def with_length(
    df: DataFrame,
    column: str = "prompt",
    template: ChatTemplate = ChatTemplate(),
    counter: Counter = word_count,
    extra_system: str | None = None,
) -> DataFrame:
    """Add ``prompt_len`` of a message list or text column.

    ``counter`` maps text to a length: words by default, a tokenizer wrapped as a
    pandas UDF if wanted. ``extra_system`` puts one more system message in front,
    even where there is one already.
    """
    value = F.col(column)
    if df.schema[column].dataType.typeName() == "array":
        if extra_system is not None:
            value = F.concat(F.array(message("system", F.lit(extra_system))), value)
        value = render(value, template)
    return df.withColumn("prompt_len", counter(value).cast("int"))


def max_length(df: DataFrame, by: str = "file") -> DataFrame:
    """Longest prompt per file, and overall where ``by`` is null."""
    return df.groupBy(by).agg(F.max("prompt_len").alias("max_len")).rollup(by).agg(F.max("max_len").alias("max_len"))


def filter_length(df: DataFrame, limit: int = PROMPT_LIMIT) -> DataFrame:
    return df.filter(F.col("prompt_len") <= limit)


def correct_text(samples: DataFrame) -> DataFrame:
    """Add the text of the correct option; null when the index is out of range."""
    return samples.withColumn("correct_text", F.get(F.col("options"), F.col("correct_option")))
