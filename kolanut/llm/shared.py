"""Frames written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a session without one (a test) gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoints-")


def written(df: DataFrame) -> DataFrame:
    """The frame as a reliable checkpoint: computed once, its lineage cut, safe from lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)


def as_table(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """The frame written as Parquet to a new place in the shared folder, and read from there.

    ``group_bytes`` bounds the row groups, for rows so large that Parquet, which looks at its buffers every hundred rows, would
    hold hundreds of MB of them.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if group_bytes is not None:
        writer = writer.options(**{"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1})
    writer.parquet(path)
    return spark.read.parquet(path)
