"""Intermediate tables that survive lost executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, a temporary one in local mode, where driver
    and executors are one process; an error anywhere else, for executors would not see each other's files."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set; {sc.master} needs a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, file: str = "") -> str:
    """A new path in the shared folder, removed at exit; with `file` that file in it."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return f"{path}/{file}" if file else path


def durable(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    del df  # with the plan its shuffle files can go
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._durable_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that durable() wrote, once nothing reads it any more; other frames are left alone."""
    path = getattr(df, "_durable_path", None)
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended
        return


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
