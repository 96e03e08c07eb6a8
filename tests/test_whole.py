"""Queries that take in all rows, against brute force."""

import hashlib
import inspect
from collections import defaultdict

import numpy as np
import pytest

from mapgauge.operators import coords
from mapgauge.plans import queries as plans


def test_coverage_by_temp_looks_at_all_answers(spark, sf):
    have = defaultdict(set)
    for r in plans.predictions(spark, sf).select("user_id", "temperature").collect():
        have[r["user_id"]].add(r["temperature"])
    want = {u: (",".join(str(int(t * 100)) for t in (0.25, 0.5, 1.0) if t not in h), {0.25, 0.5, 1.0} <= h) for u, h in have.items()}
    got = {r["user_id"]: (r["missing"], r["complete"]) for r in plans.QUERIES["coverage_by_temp"](spark, sf).collect()}
    assert got == want


def test_bootstrap_takes_2000_resamples(spark, sf):
    sides = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/events.parquet").where("event_type in ('click', 'view') and value is not null").collect():
        sides[r["event_type"]].append((r["event_id"], r["value"]))
    sides = {s: np.array([v for _, v in sorted(x)]) for s, x in sides.items()}
    middle = lambda s, v, rep: np.median(v[[int(hashlib.md5(f"0-{rep}-{s}-{k}".encode()).hexdigest()[:12], 16) % len(v) for k in range(len(v))]])
    x = [middle("click", sides["click"], rep) - middle("view", sides["view"], rep) for rep in range(2000)]
    got = plans.QUERIES["bootstrap_median_diff"](spark, sf).first()
    assert [got["low"], got["median"], got["high"]] == pytest.approx(np.quantile(x, [0.025, 0.5, 0.975]).tolist(), abs=2e-6)


def test_scaling_rounds():
    assert inspect.signature(coords.smacof).parameters["rounds"].default == 30000


def test_listed_by_metric_lists_all_orders(spark, sf):
    want = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/orders.parquet").collect():
        want[r["o_custkey"]].append((-r["o_totalprice"], r["o_orderkey"]))
    got = {r["key"]: r["top"] for r in plans.QUERIES["listed_by_metric"](spark, sf).collect()}
    assert got == {c: ",".join(str(k) for _, k in sorted(x)) for c, x in want.items()} and max(map(len, want.values())) > 5


def test_coverage_by_temp_keeps_users_whose_events_are_no_fifth(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").limit(3)
    spark.createDataFrame([(k, *r[1:]) for k, r in zip((1, 2, 4), e.select("event_id", *[c for c in e.columns if c not in ("event_id", "user_id")]).collect())], e.select("event_id", *[c for c in e.columns if c not in ("event_id", "user_id")]).schema).selectExpr("*", "cast(7 as bigint) as user_id").write.parquet(f"{tmp_path}/events.parquet")
    got = plans.QUERIES["coverage_by_temp"](spark, str(tmp_path)).collect()
    assert [(r["user_id"], r["missing"], r["complete"]) for r in got] == [(7, "25", False)]
