"""Pairs of long lists meet once, at the first list that they share."""

import numpy as np

from mapgauge.llm import near


def test_each_pair_comes_once_with_its_first_places(spark):
    r = np.random.default_rng(5)
    common = np.sort(r.integers(0, 1 << 62, 12))
    sets = [np.unique(np.concatenate([common[r.random(12) < 0.7], r.integers(0, 1 << 62, 3)])).astype(np.uint64) for _ in range(40)]
    rows = [(int(v), k, len(s), i, k) for k, s in enumerate(sets) for i, v in enumerate(s)]
    lists = spark.createDataFrame(rows, "sh long, node long, n int, i int, c long").repartition(3)
    first = spark.createDataFrame([(k, near.parities(s).tolist()) for k, s in enumerate(sets)], "node long, odd array<long>")
    got = [(x["u"], x["v"], x["i"], x["j"]) for x in near.long_pairs(lists, first, 0.5).collect()]
    want, similar = {}, set()
    for a in range(40):
        for b in range(a + 1, 40):
            both, i, j = np.intersect1d(sets[a], sets[b], return_indices=True)
            if len(both):
                want[a, b] = (i[0], j[0])
            if near.similarity(sets[a], sets[b]) >= 0.5:
                similar.add((a, b))
    assert len({g[:2] for g in got}) == len(got) and all(want[g[:2]] == g[2:] for g in got)
    assert similar and similar <= {g[:2] for g in got}
