"""What the operators share: reading tables, cutting lineage in the shared folder, global row numbers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; any path that Spark itself can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Removes a query's shuffle files when it ends, so that what has been written takes no second place on disk.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Unset, a temporary one in local mode, where all is one machine; else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder, shared by all machines, for intermediate tables")
        path = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df in the shared folder and read it again. Cuts lineage; lost executors can't undo it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name.rsplit("/", 1)[0])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """df in global order, with __part (range partition) and __k (increasing in that order), written.

    The partitions are fixed by the write, so later passes over them agree with one another.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumns({"__part": F.spark_partition_id(), "__k": F.monotonically_increasing_id()}), label)


def before(totals: DataFrame, group: list[str], sums: list[str]) -> DataFrame:
    """Exclusive prefix sums over __part of small per-partition totals, within each group."""
    w = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__part", *group, *(F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"__before_{s}") for s in sums))


def give_back() -> None:
    """Returns this process's unused memory to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that, when done, gives unused memory back to the system: its worker goes on with tasks of other stages."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def utf8(text: Column | str) -> Column:
    """The UTF-8 bytes of a text, none for null."""
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")
