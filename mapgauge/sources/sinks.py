"""Writers of results, logs and splits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> None:
    """K1."""
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    """K2: every part file has its header."""
    df.write.mode("append").option("header", True).csv(path)


def append_plain_csv(df: DataFrame, path: str, *texts: str) -> None:
    """K3: no quotes; commas in text columns become spaces, line ends too."""
    clean = {c: F.regexp_replace(F.col(c), r"[,\r\n]", " ") for c in texts}
    df.withColumns(clean).write.mode("append").option("quote", "\0").option("header", True).csv(path)


def replace_json(df: DataFrame, path: str) -> None:
    """K4: the new table is written beside the old one, which is moved aside and deleted only when the new one has its name. A
    write that fails leaves the old table as it was; readers see the one or the other, but for the moment between
    two renames."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    df.write.json(f"{path}.new-{mark}")
    fs, of = _fs(spark, path)
    old, new, to = of(f"{path}.old-{mark}"), of(f"{path}.new-{mark}"), of(path)
    had = fs.exists(to)
    if had and not fs.rename(to, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, to):
        if had:
            fs.rename(old, to)
        raise OSError(f"{path} can't be replaced")
    if had:
        fs.delete(old, True)


def _fs(spark: SparkSession, path: str):
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, through the file system of its path."""
    fs, of = _fs(spark, path)
    out = fs.create(of(path), True)
    out.write(bytearray(content))
    out.close()


def put_text(spark: SparkSession, path: str, content: str) -> None:
    put_bytes(spark, path, content.encode())


def export_csv(df: DataFrame, path: str) -> None:
    """K5: one file with a header, for small results."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def json_report(df: DataFrame) -> DataFrame:
    """K6: each row as one JSON text; nested columns stay nested."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_splits(df: DataFrame, path: str, column: str = "split", kind: str = "parquet") -> None:
    """A folder for each split, as parquet, json (lines) or csv (with a header)."""
    out = df.write.mode("overwrite").partitionBy(column)
    (out.option("header", True) if kind == "csv" else out).format(kind).save(path)
