"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunelens.session import materialise


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of newline-terminated lines; a carriage return stays.

    Files are read in splits, so one huge file still spreads over the cluster, and
    no text is shuffled: a first read leaves one row per split (its lines, its
    first row id), and a line's number is the lines of its file's earlier splits
    plus its row id's distance from the split's first.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("__row"),
        )
    )
    splits = materialise(
        lines.groupBy("file", "block").agg(F.count("*").alias("__size"), F.min("__row").alias("__first"))
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("__start", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
    # Both reads plan the same splits. Had a resized cluster planned others, row ids
    # would shift and leave some split's range: fail then, rather than misnumber.
    place = F.col("__row") - F.col("__first")
    moved = F.raise_error(F.lit("file splits moved between reads; set spark.sql.files.minPartitionNum"))
    number = F.when((place >= 0) & (place < F.col("__size")), F.col("__start") + place).otherwise(moved.cast("long"))
    return lines.join(starts, ["file", "block"], "left").select(
        "file", number.alias("line_no"), "value"
    )
