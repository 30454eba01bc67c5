"""Parquet readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PARAM_COLUMNS = ("model", "tensor", "shape", "row_idx", "values")


def read_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """One split of a tree written by ``write_splits``, by its exact name; other splits are not read.

    Folder names are text: typed by their looks, "01" and "1" would be one split.
    """
    found = spark.read.parquet(root).schema
    named = StructType([StructField(f.name, StringType()) if f.name == "split" else f for f in found])
    return spark.read.schema(named).parquet(root).filter(F.col("split") == split)


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """Every Parquet file under a glob, with the name of the file a row came from."""
    return spark.read.option("mergeSchema", "true").parquet(path).select("*", F.col("_metadata.file_path").alias("file"))


def union_splits(splits: Mapping[str, DataFrame]) -> DataFrame:
    """Splits one after another, labelled by ``split`` and its place ``split_ord``."""
    labelled = [
        df.withColumns({"split": F.lit(name), "split_ord": F.lit(place)})
        for place, (name, df) in enumerate(splits.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def write_splits(df: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """One folder per split. Tasks write what they hold, so a large split is many files."""
    df.write.mode(mode).partitionBy("split").parquet(root)


def rewrite(spark: SparkSession, source: str, target: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Change a dataset into a new version beside it and read that back.

    Spark cannot overwrite what it reads, and a failed job must leave the old
    version whole.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("write the new version to another path")
    change(spark.read.parquet(source)).write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def peek(df: DataFrame, n: int, order_by: tuple[str, ...] = ()) -> DataFrame:
    """The first few rows to look at; ordered only on request."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Parameter tables of a base and its tuned models, one matrix row, or block of one, per record."""
    found = spark.read.parquet(path)
    return found.select(*PARAM_COLUMNS, *[c for c in ("start",) if c in found.columns])
