"""Folders of run files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelens.operators.runs import is_pointer, parse_summaries
from tunelens.sources.lines import read_lines

RUN_PATTERN = r"run[-=]([^/]+)"


def with_run_id(df: DataFrame, pattern: str = RUN_PATTERN, file: str = "file") -> DataFrame:
    return df.withColumn("run_id", F.regexp_extract(file, pattern, 1))


def read_run_files(spark: SparkSession, path: str, pattern: str = RUN_PATTERN) -> DataFrame:
    """(run_id, file, text, pointer) of small files, each read whole."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )
    return with_run_id(files, pattern).withColumn("pointer", is_pointer(F.col("text")))


def load_runs(spark: SparkSession, path: str, pattern: str = RUN_PATTERN) -> DataFrame:
    """Run catalogue: one row per summary file, pointers set aside."""
    files = read_run_files(spark, path, pattern).filter(~F.col("pointer"))
    return parse_summaries(files).select("run_id", "metrics", "nested")


def read_run_logs(spark: SparkSession, path: str, pattern: str = RUN_PATTERN) -> DataFrame:
    """(run_id, line_no, value) of logs of any size, read in splits."""
    return with_run_id(read_lines(spark, path), pattern).select("run_id", "line_no", "value")
