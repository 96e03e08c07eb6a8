import json
import lzma

from pyspark.sql import functions as F

from mapgauge.operators import coverage
from mapgauge.plans import reports
from mapgauge.sources import connectors, readers, sinks
from mapgauge.streaming import scoring


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": "a"}\n\n{bad\n{"id": 2, "x": "b"}\n')
    assert readers.jsonl(spark, str(tmp_path / "a.jsonl"), "id string, x string").count() == 2
    assert readers.jsonl_with_bad(spark, str(tmp_path / "a.jsonl"), "id string, x string").cache().where("_corrupt_record is not null").count() == 1
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"id": 1}, {"id": 2}]}))
    assert readers.json_array(spark, str(tmp_path / "b.json"), "id int", "results").count() == 2
    (tmp_path / "c.csv").write_text("id,x\n1,a\n2,b\n")
    assert readers.by_suffix(spark, str(tmp_path / "c.csv"), "id int, x string").count() == 2
    (tmp_path / "d.txt.xz").write_bytes(lzma.compress("x\ny\n".encode()))
    assert [r["value"] for r in readers.xz_lines(spark, str(tmp_path / "d.txt.xz")).collect()] == ["x", "y"]
    assert readers.matching(spark, str(tmp_path), "a*.jsonl", "id string").where("id is not null").select("origin_file").distinct().count() == 1
    assert readers.template(str(tmp_path / "none")) is None
    rows = spark.createDataFrame([('["a","b"]',), ("plain",)], "o string").select(readers.text_or_first("o")).collect()
    assert [r[0] for r in rows] == ["a", "plain"]


def test_connector_keeps_failing_batches(spark):
    def make():
        def ask(prompts):
            if "bad" in prompts:
                raise RuntimeError("down")
            return [p.upper() for p in prompts]

        return ask

    rows = spark.createDataFrame([("a",), ("bad",), ("c",)], "p string").coalesce(1)
    got = {r["p"]: (r["output"], r["output_error"]) for r in connectors.generate(rows, "p", make, batch=1).collect()}
    assert got == {"a": ("A", None), "bad": (None, "RuntimeError: down"), "c": ("C", None)}
    assert connectors.generate(rows, "p").count() == 3


def test_geocode(spark):
    names = spark.createDataFrame([("x",), ("y",)], "name string")
    cache = spark.createDataFrame([("x", "1", "2")], "name string, lat string, lng string")
    known, missing = connectors.geocode(names, cache)
    assert known.where("lat is null").count() == 1 and [r[0] for r in missing.collect()] == ["y"]


def test_resume_and_sinks(spark, tmp_path):
    tasks = spark.range(5).withColumnRenamed("id", "k")
    log = str(tmp_path / "log")
    sinks.append_jsonl(tasks.where("k < 2"), log)
    sinks.append_jsonl(tasks.where("k = 3"), log)
    done = readers.jsonl(spark, log, "k long")
    assert sorted(r[0] for r in coverage.pending(tasks, done, "k").collect()) == [2, 4]
    sinks.append_plain_csv(spark.createDataFrame([("a, b",)], "t string"), str(tmp_path / "csv"), "t")
    assert readers.csv(spark, str(tmp_path / "csv"), "t string").first()[0] == "a  b"
    sinks.write_splits(spark.createDataFrame([(1, "eval"), (2, "finetune")], "i int, split string"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'eval'").count() == 1
    assert json.loads(sinks.json_report(spark.createDataFrame([(1, "x")], "a int, b string")).first()[0]) == {"a": 1, "b": "x"}


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 0.5), (None, None)], "k string, v double")
    assert "0.5000" in reports.text_table(df, "T")
    assert "a\\|b" in reports.markdown_table(df)
    assert "<td>a|b</td>" in reports.html_table(df)


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"ts": "2024-01-01T00:01:00", "t": "a", "p": "a"}\n{"ts": "2024-01-01T00:02:00", "t": "a", "p": "b"}\n')
    s = scoring.answers(spark, str(src), "ts timestamp, t string, p string")
    q = scoring.accuracy_by_window(s, "ts", "t", "p").writeStream.format("memory").queryName("acc").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["accuracy"]) for r in spark.table("acc").select("n", F.col("accuracy")).collect()] == [(2, 0.5)]
