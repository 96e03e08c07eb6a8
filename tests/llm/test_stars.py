"""Stars take in a large group of near copies without naming its pairs."""

import random

from mapgauge.llm import near
from mapgauge.llm.common import durable
from tests.llm.test_near import plain_kept, words


def group(size, seed=6):
    """Copies of one text with up to 6 words changed, of which many are similar, many are not."""
    r = random.Random(seed)
    base, rows = words(r, 150), []
    for k in range(size):
        b = list(base)
        for at in r.sample(range(150), r.randrange(7)):
            b[at] = f"z{r.randrange(10**6)}"
        rows.append((k, " ".join(b)))
    return rows


def test_pairs_left_after_the_stars(spark, monkeypatch):
    found, left = near.long_pairs, []

    def counted(*args):
        out = durable(found(*args))
        left.append(out.count())
        return out

    monkeypatch.setattr(near, "long_pairs", counted)
    rows = group(400)
    got = near.drop_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == plain_kept(rows)
    assert len(left) == 1 and left[0] < 4 * len(rows), left


def test_heads_are_of_the_largest_component_and_differ_by_list(spark):
    rows = [(sh, node, 50, 0, 1 if node < 30 else node) for sh in range(40) for node in range(50)]
    got = near.star_pairs(spark.createDataFrame(rows, "sh long, node long, n int, i int, c long"), 0).collect()
    assert len(got) == 40 * 20 and {r["v"] for r in got} == set(range(30, 50))
    assert {r["u"] for r in got} <= set(range(30)) and len({r["u"] for r in got}) > 10
