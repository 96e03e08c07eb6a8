"""What the training-data operators share: reading, durable intermediates, small column helpers."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapgauge.operators.durable import discard, durable, release, shared_dir

__all__ = ["NULL_ID", "carried_out", "discard", "durable", "framed", "id_out", "lower_ascii", "partitions", "read", "release", "shared_dir", "small_batches", "text_of", "trimmed", "with_id"]

#: Stands for a null identifier inside an operator; it sorts before every other one.
NULL_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_id(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds `_id`: the identifier as a long, NULL_ID where it is null."""
    return df.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)))


def framed(df: DataFrame, carried: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row (a struct of the carried columns, whatever their names), _id, _t (null text: empty) and _th, the text's hash."""
    small_batches(df.sparkSession)
    t = text_of(text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.struct(F.lit(0).alias("_none"))
    return df.select(row.alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), t.alias("_t"), F.xxhash64(t).alias("_th"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the rows that go to Python at a time, which both sides hold, unless the session has a setting of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def carried_out(carried: list[str]) -> list[Column]:
    """The carried columns of framed(), as columns again."""
    return [F.col("_row").getField(c).alias(c) for c in carried]


def id_out(name: str = "_id") -> Column:
    """The inverse of with_id: NULL_ID becomes null again."""
    return F.nullif(F.col(name), F.lit(NULL_ID))


def text_of(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only. A text of ASCII alone takes the fast built-in, which is the same there."""
    az = "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, az.upper(), az))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        return


def trimmed(run):
    """run, a function for mapInArrow, giving the room that it no longer uses back after each batch: workers live on, and
    Arrow's pool would hold what the largest batches took."""

    def go(batches):
        for b in run(batches):
            yield b
            del b
            _trim()
        _trim()

    return go
