"""Replay-safe batch output: every micro-batch owns one folder, and writing it again replaces it."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows written so far, with their batch_id; empty when nothing has been written."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], full)


def newest_batch(rows: DataFrame) -> DataFrame:
    """The rows of the last batch alone: each batch replaces the one before.

    The last batch is known from the folder names, and only its folder is read. A batch without rows is a batch, too.
    """
    batches = [int(n) for f in rows.inputFiles() for n in re.findall(r"/batch_id=(\d+)/", f)]
    return rows.where(F.col("batch_id") == max(batches, default=-1)).drop("batch_id")


def newest_per_key(rows: DataFrame, key: str) -> DataFrame:
    """Per key the row of the last batch that wrote it: batches update the ones before."""
    columns = [c for c in rows.columns if c not in (key, "batch_id")]
    return (
        rows.groupBy(key)
        .agg(F.max_by(F.struct(*columns), "batch_id").alias("r"))
        .select(key, *[F.col(f"r.{c}").alias(c) for c in columns])
    )
