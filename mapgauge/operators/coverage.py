"""Coverage of an experiment: what is missing, extra, done, pending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_extra(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted and not found ('missing') or found and not wanted ('extra')."""
    wanted, found = wanted.select(key).distinct(), found.select(key).distinct()
    return wanted.join(found, key, "left_anti").withColumn("kind", F.lit("missing")).unionByName(found.join(wanted, key, "left_anti").withColumn("kind", F.lit("extra")))


def pending(tasks: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Tasks whose keys the log does not hold; null keys never count as done."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def by_setting(df: DataFrame, key: str, setting: str, expected) -> DataFrame:
    """For each key the settings it lacks, sorted, and whether it has all."""
    want = F.array(*[F.lit(x) for x in expected])
    out = df.groupBy(key).agg(F.collect_set(F.when(F.col(setting).isin(*expected), F.col(setting))).alias("_have"))
    return out.select(key, F.array_sort(F.array_except(want, "_have")).alias("missing"), (F.size("_have") == len(expected)).alias("complete"))


def distinct_counts(df: DataFrame, key: str, setting: str) -> DataFrame:
    """A20."""
    pairs = F.count_distinct(F.struct(key, setting))
    return df.agg(F.count_distinct(key).alias("ids"), pairs.alias("pairs"), F.count_distinct(setting).alias("settings"))


def last_write(df: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """The value written last for each key."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))
