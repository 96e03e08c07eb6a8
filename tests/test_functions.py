import numpy as np
import pytest
from pyspark.sql import functions as F

from mapgauge.functions import geo, text
from mapgauge.operators import coords, metrics, pairs, sampling, stats


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x")).alias("y")).collect()]


def test_latlon(spark):
    got = column(spark, ["Lat 45.5, Lon -73.6", "45 N, 73 W", "45.50° N, 73.60° W", "120.5 then lat: 10.5 lon: 20.5", None, ""], text.latlon)
    assert [tuple(x) for x in got] == [(45.5, -73.6), (None, None), (45.5, 73.6), (10.5, 20.5), (None, None), (None, None)]


def test_distance(spark):
    cases = ["Answer: ~2,900 km", "2 560 km", "42.65 and 1356.6", "about 12", "no digits", "", None, "12 km"]
    got = [(x["value"], x["strategy"]) for x in column(spark, cases, text.distance)]
    assert got == [(2900.0, "unit"), (2560.0, "unit"), (1356.6, "first>=50"), (12.0, "fallback_last"), (None, None), (None, None), (None, None), (12.0, "unit")]


def test_distance_fallback(spark):
    rows = spark.createDataFrame([("", 1267.0), ("5 km", 1267.0), (None, None)], "o string, p double")
    assert [tuple(r[0]) for r in rows.select(text.distance_or("o", "p")).collect()] == [(1267.0, "fallback_predicted_dis"), (5.0, "unit"), (None, None)]


def test_directions(spark):
    assert column(spark, ["North East.", "northeast", "NORTH-EAST,", None], text.direction) == ["north-east"] * 3 + [""]
    assert column(spark, ["north east"], text.direction_v1) == ["north east"]


def test_short_answer(spark):
    assert column(spark, ["The Lake.", "a an apple", None], text.short_answer) == ["lake", "an apple", None]


def test_predicates(spark):
    assert column(spark, ["... Answer: A [overlaps/is within] B", "Answer: A [foo] B", "equals", None], text.predicate) == ["overlaps", "invalid", "equals", None]
    two = ["answer: [touches] answer: [within]"]
    assert column(spark, two, text.predicate) == ["touches"]
    assert column(spark, two, lambda c: text.predicate(c, True)) == ["within"]
    assert column(spark, ["disjoint", "equals", None], text.canonical) == ["disjoint", "equals", None]
    assert column(spark, ["disjoint", "equals", None], lambda c: text.canonical(c, strict=False)) == ["within", None, None]
    assert column(spark, ["x [Has/ straddles/odd] y", "no bracket, borders", None], text.canonical_all) == ["contains/crosses/odd", "touches", None]


def test_places_and_names(spark):
    assert column(spark, ["Lubbock, Texas", " Paris "], text.clean_name) == ["lubbock", "paris"]
    assert column(spark, ["a" * 200, "b\nc"], text.snippet) == ["a" * 180 + "...", "b c"]
    assert column(spark, ["a\n\nb\n\nc\n\nPlace: Rome"], lambda c: text.generated_place(c, F.lit("Place: "))) == ["Rome"]
    phase, shot = text.file_phase("x")
    rows = spark.createDataFrame([("gen_dis_p3_zero-shot.json",), ("gen_dis_p3_tag-3-shot.json",)], "x string").select(phase, shot).collect()
    assert [tuple(r) for r in rows] == [("p3", "zero-shot"), (None, None)]


def test_first_place(spark):
    t = spark.createDataFrame([(1, "in the new york city and rome now", "Rome"), (2, "rome", None), (3, None, None), (4, "x rome. y", None), (5, "to rome or new york then", None)], "id int, t string, own string")
    g = spark.createDataFrame([("Rome, Italy", 0), ("New York, NY", 1), ("York, UK", 2)], "place string, ord int")
    got = {r["id"]: r["place"] for r in pairs.first_place(t, g, "t", "own").collect()}
    assert got == {1: "new york", 2: None, 3: None, 4: None, 5: "rome"}


def test_geodesics(spark):
    d = geo.vincenty_km([0, 50.06632, 0, 10], [0, -5.71475, 0, 10], [0, 58.64402, 0, 10], [1, -3.07009, 180, 10])
    assert d[0] == pytest.approx(111.319490793, abs=1e-6)  # a degree of the equator
    assert d[1] == pytest.approx(969.95, abs=0.05)
    assert d[3] == 0 and np.isfinite(d).all()
    row = spark.range(1).select(geo.haversine_km(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("a"), geo.haversine_km(F.lit(3.0), F.lit(4.0), F.lit(1.0), F.lit(2.0)).alias("b")).first()
    assert row["a"] == pytest.approx(row["b"]) and row["a"] == pytest.approx(314.40, abs=0.01)


#: Published counts and their entropies.
GOLDEN = [({"touches": 31, "disjoint": 15, "contains": 11, "within": 11, "overlaps": 6}, 2.1040382957577553)]


def test_entropy_golden(spark):
    for counts, want in GOLDEN:
        rows = spark.createDataFrame([("g", k, v) for k, v in counts.items()], "truth string, predicted string, n long")
        got = metrics.entropy(rows, "truth").first()
        assert got["entropy"] == pytest.approx(want, abs=1e-12)
        assert got["distribution"] == counts
    pure = spark.createDataFrame([("g", "x", 5), ("h", None, 2)], "truth string, predicted string, n long")
    assert {r["truth"]: (str(r["entropy"]), r["total"]) for r in metrics.entropy(pure, "truth").collect()} == {"g": ("0.0", 5), "h": ("0.0", 2)}


def test_weighted_recall_is_accuracy(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", None), ("c", "z")], "t string, p string")
    out = metrics.weighted(metrics.per_class(metrics.counts(rows, "t", "p"))).first()
    assert out["weighted_recall"] == pytest.approx(out["accuracy"]) == pytest.approx(0.4)


def test_error_summary_null_group(spark):
    rows = spark.createDataFrame([("0", 1.0), ("0", None), (None, 7.0)], "p string, e double")
    got = {r["p"]: (r["total"], r["parsed"], r["within_5"]) for r in metrics.error_summary(rows, "p", "e").collect()}
    assert got == {"0": (2, 1, 1), "unknown": (1, 1, 0), "all": (3, 2, 1)}


def test_null_prediction_stays(spark):
    rows = spark.createDataFrame([(None,), ("error",), ("skipped",), ("x",)], "predicted string")
    assert rows.where(metrics.scored()).count() == 2


def test_splits(spark):
    rows = spark.range(103).withColumn("label", F.col("id") % 3)
    s = sampling.split_random(rows, "id", 0.7)
    assert s.where("split = 'train'").count() == 103 - 73 and s.count() == 103
    assert s.select("id").distinct().count() == 103
    t = sampling.split_stratified(rows, "label", "id", 0.3)
    assert t.where("split = 'eval'").count() == 103 - 73
    sizes = {r["label"]: r["n"] for r in t.where("split = 'eval'").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_exemplars(spark):
    rows = spark.createDataFrame([(i, "a" if i < 6 else "b" if i < 8 else "c") for i in range(9)], "id int, g string")
    got = sampling.exemplars(rows, "id", 3, "g").collect()
    assert all(r["id"] != r["exemplar"] for r in got)
    n = {}
    for r in got:
        n.setdefault(r["id"], set()).add(r["exemplar"])
    assert [len(n.get(i, ())) for i in range(9)] == [3] * 6 + [1, 1, 0]


def test_oversample(spark):
    rows = spark.createDataFrame([(i, "a" if i < 60 else "b") for i in range(65)], "id int, label string")
    got = sampling.oversample(rows, "label", "id", 50)
    assert {r["label"]: r["n"] for r in got.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": 60, "b": 50}


def test_mann_whitney_by_hand(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)], "s string, v double")
    r = stats.mann_whitney(rows, "v", "s", "a", "b").first()
    assert r["u"] == pytest.approx(1.0) and 0 < r["p"] < 1


def test_align_recovers_similarity():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 2))
    a = 0.7
    rot = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    y = (rot @ x.T).T + [3, -2]
    r, _, _ = coords.align(x, y)
    assert np.allclose(r, rot)


def test_scaling_recovers_distances():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    y = coords.smacof(d, x + rng.normal(scale=0.1, size=x.shape), eps=1e-12)
    e = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    assert np.abs(d - e).max() < 1e-2


def test_nearest_in_blocks(spark):
    rows = spark.createDataFrame([(f"p{i}", float(i * 7 % 60), float(i * 13 % 100)) for i in range(30)], "name string, lat double, lon double")
    assert sorted(pairs.nearest_farthest(rows).collect()) == sorted(pairs.nearest_farthest(rows, small=7).collect())
