"""The labeller over a stream of text lines: the same functions as over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokenize
from ..operators.labels import Crf, labeller, reduce_labels


def label_lines(lines: DataFrame, model: Crf, column: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, categories as JSON) of each line; stateless, so it reads batch and streaming frames alike."""
    labelled = lines.withColumn("tokens", tokenize(column, ends=True)).withColumn("labels", labeller(model)("tokens"))
    return labelled.select(*keys, F.col(column).alias("value"), F.to_json(reduce_labels("tokens", "labels")).alias("json"))


def listen(spark: SparkSession, path: str, out: str, checkpoint: str, model: Crf) -> StreamingQuery:
    """Label the lines of all files that come to a folder, and stop when those there are done."""
    stream = label_lines(spark.readStream.text(path), model)
    return stream.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
