"""Session helpers: the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_NAMED: list[str] = []  # paths given out in this process


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tunelens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, kept until ``clean_work``."""
    _NAMED.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _NAMED[-1]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, so every later use reads the same rows.

    A Parquet table rather than an RDD checkpoint: it survives lost executors as
    well, later reads touch only the columns they use, and its size is known to
    the join planner.
    """
    path = work_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_work(spark: SparkSession) -> None:
    """Delete what ``work_path`` named in this session; call it when results have been written."""
    while _NAMED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_NAMED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
