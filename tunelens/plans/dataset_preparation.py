"""Raw question files to prompt tables, end to end."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tunelens.functions.messages import TRAINING_SYSTEM
from tunelens.operators.prompts import training_prompt
from tunelens.operators.records import build_samples, group_records, normalise_records, rejected_samples
from tunelens.sources.lines import read_lines
from tunelens.sources.tables import union_splits, write_splits


def samples_from_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Numbered lines to samples: one shuffle, at the grouping of lines."""
    return build_samples(normalise_records(group_records(lines)), strict)


def prompts_from_lines(lines: DataFrame, system: str = TRAINING_SYSTEM, strict: bool = False) -> DataFrame:
    return training_prompt(samples_from_lines(lines, strict), system).select("file", "record", "prompt", "answer")


def rejects_from_lines(lines: DataFrame) -> DataFrame:
    """The records that ``prompts_from_lines`` leaves out."""
    return rejected_samples(normalise_records(group_records(lines)))


def prepare_splits(
    spark: SparkSession,
    paths: Mapping[str, str],
    root: str,
    system: str = TRAINING_SYSTEM,
    strict: bool = False,
    rejects: str | None = None,
) -> None:
    """Read each split's raw files and write the prompt table of all splits.

    Records with a bad answer line fail the job if ``strict``; otherwise they are
    written to ``rejects``, by default beside ``root``, so that none is lost unseen.
    """
    lines = {name: read_lines(spark, path) for name, path in paths.items()}
    prompts = {name: prompts_from_lines(rows, system, strict) for name, rows in lines.items()}
    write_splits(union_splits(prompts).select("prompt", "answer", "split"), root)
    if not strict:
        left = {name: rejects_from_lines(rows) for name, rows in lines.items()}
        write_splits(union_splits(left).drop("split_ord"), rejects or f"{root.rstrip('/')}_rejects")
