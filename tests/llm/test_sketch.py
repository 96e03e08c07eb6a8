"""The sketch never rules out a pair that is similar enough."""

import numpy as np
import pytest

from mapgauge.llm import near


@pytest.mark.parametrize("n", [1, 7, 150, 5000])
def test_sketch_is_a_bound(n):
    r = np.random.default_rng(n)
    for changed in {0, n // 20, n // 10, n // 4}:
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[changed:], r.integers(0, 1 << 63, changed, dtype=np.uint64)]))
        p, q = near.parities(a), near.parities(b)
        assert len(p) == near.LONGS and np.bitwise_count((p ^ q).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_pairs_at_the_limit_stay(spark):
    r = np.random.default_rng(1)
    rows = []
    for k in range(40):
        a = np.unique(r.integers(0, 1 << 63, 90, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:80], r.integers(0, 1 << 63, 10, dtype=np.uint64)]))  # 80 of 100
        rows.append((k, near.parities(a).tolist(), near.parities(b).tolist(), len(a), len(b)))
    got = spark.createDataFrame(rows, "k int, p array<long>, q array<long>, n int, m int").where(near._may(0.8))
    assert got.count() == len(rows)
    far = [(0, near.parities(np.arange(0, 64, dtype=np.uint64) << np.uint64(55)).tolist(), near.parities(np.arange(64, 128, dtype=np.uint64) << np.uint64(55)).tolist(), 64, 64)]
    assert spark.createDataFrame(far, "k int, p array<long>, q array<long>, n int, m int").where(near._may(0.8)).count() == 0
