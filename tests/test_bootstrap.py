"""The bootstrap's draws by many digests at once."""

import hashlib
import random

import numpy as np
import pytest

from mapgauge.functions.digest import digits_of, md5_48
from mapgauge.operators import stats


@pytest.mark.parametrize("prefix", ["", "0-7-click-", "0-1999-view-", "a longer seed of many characters, with ä, -3-x-", "y" * 70])
@pytest.mark.parametrize("first", [0, 10, 99990, 1234567])
def test_md5(prefix, first):
    n = min(10, 10 ** len(str(first)) - first)
    want = [int(hashlib.md5(f"{prefix}{k}".encode()).hexdigest()[:12], 16) for k in range(first, first + n)]
    assert md5_48(prefix.encode(), digits_of(first, n)).tolist() == want


def test_no_draw_is_a_row(spark, monkeypatch):
    """The plan makes no row for each draw and resample, and blocks and groups change nothing."""
    r = random.Random(1)
    df = spark.createDataFrame([(k, r.choice("abc"), round(r.random(), 3)) for k in range(300)], "k long, s string, v double").repartition(3)
    monkeypatch.setattr(stats, "BLOCK", 7)
    monkeypatch.setattr(stats, "GROUPS", 5)
    out = stats.bootstrap_median_difference(df, "v", "s", "a", "b", "k", reps=40)
    assert "md5(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.first()
    sides = {s: [x["v"] for x in sorted(df.collect()) if x["s"] == s] for s in "ab"}
    mid = lambda s, rep: np.median([sides[s][int(hashlib.md5(f"0-{rep}-{s}-{k}".encode()).hexdigest()[:12], 16) % len(sides[s])] for k in range(len(sides[s]))])
    want = np.quantile([mid("a", k) - mid("b", k) for k in range(40)], [0.025, 0.5, 0.975])
    assert list(got) == pytest.approx(want.tolist(), abs=1e-9)
