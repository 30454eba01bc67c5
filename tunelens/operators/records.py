"""Raw question lines to question samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.functions.common import int_div
from tunelens.functions.text import answer_index, normalise_sentence, strip_option

# The layout of a raw record.
LINES_PER_RECORD = 8
ANSWER_LINE, CONTEXT_LINE, QUERY_LINE = 1, 2, 3
FIRST_OPTION_LINE, OPTIONS = 4, 4


def group_records(lines: DataFrame, size: int = LINES_PER_RECORD) -> DataFrame:
    """(file, record, lines) for every complete run of ``size`` lines of a file.

    A group never has more than ``size`` rows. Lines of a record mostly share a
    task already, so the partial aggregate folds them before the shuffle.
    """
    slot = (F.col("line_no") % size).cast("int")
    grouped = lines.groupBy("file", int_div(F.col("line_no"), size).alias("record")).agg(
        F.collect_list(F.struct(slot.alias("slot"), F.col("value").alias("value"))).alias("rows")
    )
    complete = grouped.filter(F.size("rows") == size)
    return complete.select(
        "file", "record", F.transform(F.array_sort("rows"), lambda r: r["value"]).alias("lines")
    )


def _sampled(records: DataFrame) -> DataFrame:
    line = lambda i: F.get("lines", F.lit(i))
    return records.select(
        "file",
        "record",
        line(CONTEXT_LINE).alias("context"),
        line(QUERY_LINE).alias("query"),
        F.array(*[strip_option(line(FIRST_OPTION_LINE + i)) for i in range(OPTIONS)]).alias("options"),
        answer_index(line(ANSWER_LINE)).alias("correct_option"),
        F.lit(OPTIONS).alias("options_len"),
        line(ANSWER_LINE).alias("answer_line"),
    )


def normalise_records(records: DataFrame) -> DataFrame:
    """Close every line's sentence; cleaning whole records keeps one projection per record."""
    return records.withColumn("lines", F.transform("lines", normalise_sentence))


def build_samples(records: DataFrame, strict: bool = False) -> DataFrame:
    """Question samples of cleaned records.

    Records whose answer line is not found are left to ``rejected_samples``;
    ``strict`` fails the job on the first one instead.
    """
    samples = _sampled(records)
    if not strict:
        return samples.filter(F.col("correct_option") >= 0).drop("answer_line")
    failure = F.raise_error(F.concat(F.lit("bad answer line: "), F.col("answer_line"))).cast("int")
    checked = F.when(F.col("correct_option") >= 0, F.col("correct_option")).otherwise(failure)
    return samples.withColumn("correct_option", checked).drop("answer_line")


def rejected_samples(records: DataFrame) -> DataFrame:
    """Records that ``build_samples`` leaves out, with their answer line."""
    return _sampled(records).filter(F.col("correct_option") < 0).select("file", "record", "answer_line")
