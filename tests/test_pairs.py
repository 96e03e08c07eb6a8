"""Nearest and farthest by position, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mapgauge.functions import geo
from mapgauge.operators import pairs


def hav(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return round(geo.RADIUS_KM * 2 * math.atan2(math.sqrt(h), math.sqrt(max(0, 1 - h))), 6)


@pytest.mark.parametrize("small", [pairs.SMALL, 4])
def test_places_at_one_position_and_of_one_name(spark, small):
    r = random.Random(2)
    rows = [(f"p{r.randrange(40)}", float(r.randrange(3) * 40 - 30), float(r.randrange(4) * 50)) for _ in range(70)] + [("alone", 80.0, 10.0)]
    df = spark.createDataFrame(rows + [("void", None, 1.0)], "name string, lat double, lon double").repartition(3)
    seen = []

    def counted(*a):
        seen.append(a)
        return F.round(geo.haversine_km(*a), 6)

    got = {x["name"]: tuple(x)[1:] for x in pairs.nearest_farthest(df, distance=counted, small=small).collect()}
    want = {}
    for n in {x[0] for x in rows}:
        d = [(hav(a[1:], b[1:]), b[0]) for a in rows if a[0] == n for b in rows if b[0] != n]
        near, far = min(d), min((-x, m) for x, m in d)
        want[n] = (near[1], near[0], far[1], -far[0])
    assert got.pop("void") == (None, None, None, None)
    assert got == want and seen


def test_distances_are_between_positions(spark):
    """3,000 places at 9 positions: no more than 2 * 81 distances, where all pairs are 9 million."""
    n = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def far(a, b, c, d):
        n.add(1)
        return abs(a - c) + abs(b - d)

    df = spark.range(3000).selectExpr("concat('p', id) as name", "cast(id % 3 as double) as lat", "cast(id % 9 as double) as lon")
    assert pairs.nearest_farthest(df, distance=far).count() == 3000
    assert 81 <= n.value <= 2 * 81
