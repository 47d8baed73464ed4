"""Intermediate tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; unset, a temporary one in local mode, where all is one machine, and an error elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder, shared by all machines, for intermediate tables")
        path = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written and read again: computed once, with its partition numbers fixed, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}"


def bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """df saved once as a table in buckets by keys, sorted by them, its files in the shared folder: tables of equal keys and buckets join without a shuffle."""
    rows = df.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", saved_path(df.sparkSession, name)).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)
