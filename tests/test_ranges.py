"""Running sums and quantiles over range partitions; alignment from sums; files replaced whole; what strict readers do."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mapgauge.functions import text
from mapgauge.operators import coords, durable, metrics, relational, stats
from mapgauge.sources import readers, sinks


@pytest.fixture(scope="module")
def values(spark):
    r = np.random.default_rng(0)
    rows = [(g, float(v)) for g, n in (("a", 700), ("b", 1), ("c", 2), (None, 50)) for v in r.integers(0, 60, n) / 4] + [("a", None), ("d", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(6), pd.DataFrame(rows, columns=["g", "v"])


def test_quantiles(values):
    df, plain = values
    shares = [0, 0.025, 0.25, 0.5, 0.9, 1]
    got = {r["g"]: r["q"] for r in relational.quantiles(df, "v", shares, "g").collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, q in got.items():
        own = plain[plain.g.isna() if g is None else plain.g == g].v.dropna()
        assert q == pytest.approx(np.quantile(own, shares).tolist())
    whole = relational.quantiles(df, "v", shares).first()["q"]
    assert whole == pytest.approx(np.quantile(plain.v.dropna(), shares).tolist())
    assert relational.quantiles(df.limit(0), "v", [0.5], "g").count() == 0


def test_ranks_and_running_sums(values):
    df, plain = values
    got = {(r["g"], r["v"]): (r["rank"], r["_size"]) for r in stats.ranked(df, "v", "g").collect()}
    for g in ("a", "c"):
        own = plain[plain.g == g].v.dropna()
        assert {v: k for (h, v), (k, _) in got.items() if h == g} == dict(zip(own, own.rank()))
    rows = df.sparkSession.range(500).withColumn("ok", F.col("id") % 7 == 0).repartition(5)
    out = metrics.running_accuracy(rows, "id", "ok").orderBy("id").collect()
    assert [(r["seen"], round(r["running_accuracy"], 9)) for r in out] == [(k + 1, round((k // 7 + 1) / (k + 1), 9)) for k in range(500)]


def test_no_task_sees_all_rows(values, spark):
    for df in (stats.spearman(spark.range(500).selectExpr("id as a", "id % 9 as b"), ["a", "b"]), metrics.group_stats(values[0], "v", "g"), stats.boxplot(values[0], "v", "g")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan


def test_align_by_group_equals_align(spark):
    r = np.random.default_rng(1)
    rows = [(g, *p) for g in range(6) for p in r.normal(size=(20, 4)).tolist()]
    rows += [(9, *p, -p[0], p[1]) for p in r.normal(size=(9, 2)).tolist()] + [(10, 1.0, 2.0, 3.0, 4.0)]
    got = {x["g"]: x for x in coords.align_by_group(spark.createDataFrame(rows, "g int, a double, b double, c double, d double"), "g", ("a", "b"), ("c", "d")).collect()}
    for g in [*range(6), 9]:
        own = np.array([x[1:] for x in rows if x[0] == g])
        rot, t, s = coords.align(own[:, :2], own[:, 2:])
        x = got[g]
        assert [x["r00"], x["r01"], x["r10"], x["r11"], x["tx"], x["ty"], x["s"]] == pytest.approx([*rot.ravel(), *t, s], abs=1e-9)
    assert got[10]["s"] is None


def test_strict_reader_raises(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{bad\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.jsonl(spark, str(tmp_path / "a.jsonl"), "id int", strict=True).collect()


def test_a_failed_replacement_leaves_the_old_table(spark, tmp_path):
    to = str(tmp_path / "t")
    sinks.replace_json(spark.range(3), to)
    with pytest.raises(Exception):
        sinks.replace_json(spark.range(3).select(F.raise_error(F.lit("stop")).alias("x")), to)
    assert readers.jsonl(spark, to, "id long").count() == 3


def test_shared_folder_is_asked_for(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable.shared_dir(Session())


def test_prompt_slots_and_stamps(spark):
    one = spark.createDataFrame([("Paris, France",)], "c string")
    assert one.select(text.fill("{x} and {y}!", x="c", y=F.lit("Rome"))).first()[0] == "Paris, France and Rome!"
    assert one.select(text.topology_prompt("c", "c", "c", exemplars=F.array().cast("array<string>"))).first()[0] == one.select(text.topology_prompt("c", "c", "c")).first()[0]
    stamps = one.crossJoin(spark.range(20)).select(*[c.alias(k) for k, c in text.run_stamp().items()]).collect()
    assert len({r["request_id"] for r in stamps}) == 20 and all(len(r["request_id"]) == 32 and r["created_at"][10] == "T" for r in stamps)
