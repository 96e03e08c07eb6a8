"""Suffix ranks of repetitive texts, byte comparison, and repeated strings found the same at any size of leaves."""

from collections import Counter

import numpy as np
import pytest

from mapgauge.llm import suffix_dedup
from tests.llm.test_operators import strings_kept


def ranks(texts):
    s, b, e = [0], [], []
    for t in texts:
        b.append(len(s))
        s += [*t, 0]
        e.append(len(s))
    return s, b, e, suffix_dedup.suffix_ranks(np.array(s, np.int64), np.array(b), np.array(e))


def fibonacci(n):
    a, b = [1], [1, 2]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_repetitive_texts():
    r = np.random.default_rng(0)
    base = r.integers(1, 5, 60).tolist()
    texts = [[1] * 200, [2, 1] * 80, [1, 2] * 80, fibonacci(300), [1, 1, 2] * 50 + [3], base * 5, list(range(1, 150)), list(range(150, 0, -1)), [5], [], *[base[:k] + [7] + base[k:] for k in range(0, 60, 7)]]
    s, b, e, rank = ranks(texts)
    for x, y in zip(b, e, strict=True):
        own = s[x:y]
        assert np.argsort(rank[x:y]).tolist() == sorted(range(len(own)), key=lambda i: own[i:])


def test_lyndon_prefixes():
    r = np.random.default_rng(1)
    t = r.integers(1, 4, 200).tolist()
    s = np.array([0, *t, 0], np.int64)
    group, prev, prefix = suffix_dedup.lyndon_groups(s, np.array([1]), np.array([len(s)]))
    order = lambda w: all(w < w[i:] for i in range(1, len(w)))
    names = {}
    for i in range(1, len(s) - 1):
        longest = max(k for k in range(1, len(s) - i) if order(s[i : i + k].tolist()))
        assert prefix[i] == longest
        assert names.setdefault(tuple(s[i : i + longest].tolist()), group[i]) == group[i]
    assert len(set(names.values())) == len(names)


def test_equal_stretches():
    r = np.random.default_rng(2)
    flat = np.tile(r.integers(0, 3, 40), 6).astype(np.uint8)
    flat[r.integers(0, 240, 4)] = 9
    a, b = r.integers(0, 220, 3000), r.integers(0, 220, 3000)
    a[:500], b[:500] = np.tile(np.arange(100), 5), np.tile(np.arange(100), 5) + np.repeat(40 * np.arange(1, 4), [200, 200, 100])
    pairs = sorted({(x, y) for x, y in zip(a.tolist(), b.tolist()) if max(x, y) + 12 <= 240})
    a, b = (np.array(x) for x in zip(*pairs))
    assert suffix_dedup.equal_stretches(flat, a, b, 12).tolist() == [(flat[x : x + 12] == flat[y : y + 12]).all() for x, y in pairs]


@pytest.mark.parametrize("together", [2, 12, 10**6])
def test_leaves_of_any_size(spark, monkeypatch, together):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    r = np.random.default_rng(5)
    base = bytes(r.integers(97, 100, 500, dtype=np.uint8)).decode()
    rows = []
    for i in range(30):
        t = list(base)
        for k in r.integers(0, 500, 2):
            t[k] = "-"
        rows.append((i, f"{r.integers(0, 10**9)}" + "".join(t) + f"{r.integers(0, 10**9)}"))
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in got) == strings_kept(rows)
