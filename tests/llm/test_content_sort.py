"""The content sort: splitters cut by bytes, and through copies by id; equal texts that lie in several partitions meet."""

from collections import Counter

import pytest

from mapgauge.llm import exact_dedup
from tests.llm.test_operators import sha


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    return Counter((i, max(groups[t]), len(groups[t]), i == max(groups[t]), sha(t.encode())) for i, t in rows)


def table():
    hot = "h" * 3000
    rows = [(i, hot) for i in range(0, 900, 3)] + [(i, hot + "x" * (i % 2)) for i in range(1, 300, 3)] + [(i, "h" * (i % 7)) for i in range(2, 300, 3)]
    rows += [(1000 + i, f"common start of many texts, {i % 40}" + "é" * (i % 3)) for i in range(400)] + [(2000 + i, f"t{i}") for i in range(200)]
    return rows + [(3000, ""), (3001, ""), (3002, "a"), (3003, "a\x00"), (3004, "a\x00"), (3005, "\U0010ffff"), (3006, "\U0010ffff" * 400), (3007, "\U0010ffff" * 400)]


@pytest.mark.parametrize("head", [1, 8, 1024])
def test_any_head_gives_the_same(spark, monkeypatch, head):
    monkeypatch.setattr(exact_dedup, "HEAD", head)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = exact_dedup.exact_dedup(spark.createDataFrame(table(), "doc_id long, text string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == plain(table())


def test_partitions_are_ranges_of_bytes(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(table(), "_id long, _norm string").repartition(5)
    cuts = exact_dedup.splitters(rows, 13)
    assert len(cuts) == 12 and max(len(h) for h, _ in cuts) <= 1024 and min(len(h) for h, _ in cuts) < 40
    at = rows.withColumn("at", F.arrow_udf(exact_dedup._placed(cuts), "long")(exact_dedup.head_of(F.col("_norm")), "_id")).collect()
    size = Counter(r["at"] // 2 for r in at)
    assert set(size) <= set(range(13)) and max(size.values()) < 2.5 * len(at) / 13
    parts = {}
    for r in at:
        parts.setdefault(r["_norm"].encode() + b"\xff", set()).add((r["at"] // 2, r["at"] % 2))
    order = [parts[k] for k in sorted(parts)]
    for a, b in zip(order, order[1:]):
        if {e for _, e in a | b} == {0}:
            assert max(a) <= min(b)
    assert all({e for _, e in p} == {1} for p in parts.values() if len(p) > 1)
    assert exact_dedup.splitters(rows.limit(0), 13) == [] and exact_dedup.splitters(rows, 1) == []


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_a_text_may_fill_whole_batches(spark, keep):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10")
    rows = [(i, "same") for i in range(100)] + [(200 + i, "zz"[: i % 3]) for i in range(60)]
    try:
        got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep).collect()
    finally:
        spark.conf.set(name, before)
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    stays = {t: (max if keep == "largest" else min)(g) for t, g in groups.items()}
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == Counter((i, stays[t], len(groups[t]), i == stays[t], sha(t.encode())) for i, t in rows)
