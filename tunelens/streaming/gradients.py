"""Gradient telemetry as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tunelens.functions.vectors import GRADIENT_THRESHOLD

LATENESS = "1 hour"


def streaming_metrics(
    grads: DataFrame,
    arrival: str = "logged_at",
    lateness: str = LATENESS,
    threshold: float = GRADIENT_THRESHOLD,
) -> DataFrame:
    """Sums for the norm and near-zero share per (step, parameter) of a stream.

    Sums are kept per arrival time as well, which lets the watermark drop the
    state of finished steps; ``latest_metrics`` adds up the arrival times of a step.
    """
    grad = F.col("grad")
    return (
        grads.filter(grad.isNotNull())
        .withWatermark(arrival, lateness)
        .groupBy(F.col(arrival).alias("arrived"), "step", "name")
        .agg(
            F.sum(grad * grad).alias("squares"),
            F.sum((F.abs(grad) < threshold).cast("long")).alias("near_zero"),
            F.count("*").alias("entries"),
        )
    )


def start_metrics(metrics: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's changed groups under its batch number.

    A batch that is run again after a failure overwrites its own folder, so the
    table holds every update exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={number}")

    return (
        metrics.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_metrics(spark: SparkSession, table: str) -> DataFrame:
    """Norm and near-zero share of every (step, parameter), from the newest update of each arrival time."""
    values = F.struct("squares", "near_zero", "entries")
    newest = (
        spark.read.parquet(table)
        .groupBy("arrived", "step", "name")
        .agg(F.max_by(values, "batch_id").alias("newest"))
        .select("step", "name", "newest.*")
    )
    return newest.groupBy("step", "name").agg(
        F.sqrt(F.sum("squares")).alias("grad_norm"),
        (F.sum("near_zero") / F.sum("entries")).alias("grad_sparsity"),
        F.sum("entries").alias("entries"),
    )
