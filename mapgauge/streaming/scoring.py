"""Answers that arrive over time, scored as they come: an extra beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def answers(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of JSON-lines answer files."""
    return spark.readStream.schema(schema).json(folder)


def accuracy_by_window(stream: DataFrame, time: str, truth: str, predicted: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Accuracy in windows of event time; answers later than `late` are left out once their window is closed."""
    hit = F.coalesce(F.col(truth) == F.col(predicted), F.lit(False)).cast("int")
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def new_only(stream: DataFrame, time: str, *keys: str, late: str = "1 day") -> DataFrame:
    """The first answer for each key within the watermark: what resuming from an append-only log does in batches."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
