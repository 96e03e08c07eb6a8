"""Readers of question, answer and result files, each with a stated schema."""

from __future__ import annotations

import lzma

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapgauge.functions.text import strip

BAD = "_corrupt_record"


def _ddl(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def jsonl(spark: SparkSession, path, schema, strict: bool = False) -> DataFrame:
    """One object a line; blank lines are skipped. strict raises at a bad line, otherwise it is skipped."""
    if strict:
        return spark.read.schema(_ddl(schema)).option("mode", "FAILFAST").json(path)
    return spark.read.schema(_ddl(schema)).option("mode", "DROPMALFORMED").json(path)


def jsonl_with_bad(spark: SparkSession, path, schema) -> DataFrame:
    """R2, for audits: bad lines stay, as text, in _corrupt_record."""
    return spark.read.schema(T.StructType([*_ddl(schema).fields, T.StructField(BAD, T.StringType())])).option("columnNameOfCorruptRecord", BAD).json(path)


def json_array(spark: SparkSession, path, schema, field: str | None = None) -> DataFrame:
    """Whole files that hold an array, or with `field` an object that holds one."""
    reader = spark.read.option("multiLine", True)
    if field is None:
        return reader.schema(_ddl(schema)).json(path)
    rows = reader.schema(T.StructType([T.StructField(field, T.ArrayType(_ddl(schema)))])).json(path)
    return rows.select(F.inline(field))


def csv(spark: SparkSession, path, schema, preview: int | None = None, **options) -> DataFrame:
    """With a header; preview keeps the first rows."""
    out = spark.read.schema(_ddl(schema)).options(header=True, **options).csv(path)
    return out if preview is None else out.limit(preview)


def gazetteer(spark: SparkSession, path) -> DataFrame:
    """Tab-separated degrees and minutes, no header."""
    kind = "name string, lat_deg int, lat_min int, lng_deg int, lng_min int, local_time string"
    return spark.read.schema(kind).csv(path, sep="\t")


def by_suffix(spark: SparkSession, path: str, schema) -> DataFrame:
    """Csv, tsv, jsonl, ndjson, json (lines), parquet, by the file's suffix. Pickles are not read: convert them to parquet."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.schema(_ddl(schema)).parquet(path)
    if kind in ("csv", "tsv"):
        return csv(spark, path, schema, sep="\t" if kind == "tsv" else ",")
    if kind in ("jsonl", "ndjson"):
        return jsonl(spark, path, schema)
    if kind == "json":
        lines = jsonl(spark, path, schema)
        return lines if not lines.isEmpty() else json_array(spark, path, schema)
    raise ValueError(f"no reader for {path}")


def matching(spark: SparkSession, folder, pattern: str, schema) -> DataFrame:
    """The JSON-lines files of a folder whose names match, with origin_file."""
    rows = spark.read.schema(_ddl(schema)).option("pathGlobFilter", pattern).json(folder)
    return rows.withColumn("origin_file", F.col("_metadata.file_name"))


def xz_lines(spark: SparkSession, path) -> DataFrame:
    """Lines of xz files, one task a file. The compressed file is one row (2 GB at most); what it holds is decompressed as a stream."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                import io

                with lzma.open(io.BytesIO(content), "rt", encoding="utf-8") as f:
                    part = []
                    for line in f:
                        part.append(line.rstrip("\n"))
                        if len(part) == 10_000:
                            yield pd.DataFrame({"path": name, "value": part})
                            part = []
                    if part:
                        yield pd.DataFrame({"path": name, "value": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, value string")


#: The labels of a text report's lines, and the type of each value.
REPORT = {
    "file_name": ("File", "string"),
    "eval_time": ("Evaluation Time", "string"),
    "total_samples": ("Total Samples", "int"),
    "valid_predictions": ("Valid Predictions", "int"),
    "prediction_rate": ("Prediction Rate", "double"),
    "mean_error_km": ("Mean Error", "double"),
    "median_error_km": ("Median Error", "double"),
}


def report_fields(text: Column | str) -> dict[str, Column]:
    """The fields of a report's text; null where a line is missing."""
    c = F.col(text) if isinstance(text, str) else text
    out = {}
    for name, (label, kind) in REPORT.items():
        value = r"([^\n]*)" if kind == "string" else r"(-?[0-9]+(?:\.[0-9]+)?)"
        got = F.nullif(strip(F.regexp_extract(c, rf"(?m)^\s*{label}[^:\n]*:\s*{value}", 1)), F.lit(""))
        out[name] = got if kind == "string" else got.try_cast(kind)
    return out


def reports(spark: SparkSession, path) -> DataFrame:
    """A row for each report file."""
    rows = spark.read.text(path, wholetext=True).withColumn("report_file", F.col("_metadata.file_name"))
    return rows.select("report_file", *[c.alias(k) for k, c in report_fields("value").items()])


def text_or_first(c: str) -> Column:
    """A field that holds a string or an array of strings, read as a string: the first element of an array."""
    return F.coalesce(F.get(F.from_json(F.col(c), "array<string>"), F.lit(0)), F.col(c))


def template(path: str) -> str | None:
    """A prompt template, read on the driver; None if there is none."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return None
