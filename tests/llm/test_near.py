"""Near copies by similarity against all pairs, and rows whose ids are null or repeat."""

import random
import re

from mapgauge.llm import near
from tests.llm.test_operators import LOW, order, plain_components, raw


def plain_shingles(t, words=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw(t).translate(LOW))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain_kept(rows, least=0.8):
    """Texts of the smallest id of each component; rows here have no two ids in a component that tie."""
    rows = sorted({(order(i), t or "") for i, t, *_ in rows})
    sets = [plain_shingles(t) for _, t in rows]
    comp = plain_components(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(sets[a], sets[b]) >= least])
    return sorted(rows[k] for k in set(comp.values()))


def words(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def planted():
    """Texts with one or two rewritten copies each, of similarities about 0.8; unrelated texts that share a passage."""
    r = random.Random(3)
    rows, passage, seen = [], words(r, 60), []
    for k, (n, change) in enumerate([(150, 1), (150, 2), (150, 3), (300, 3), (300, 5), (300, 6), (300, 7), (900, 17), (60, 1)] * 4):
        a = words(r, n)
        b = list(a)
        for at in r.sample(range(n), change):
            b[at] = f"x{r.randrange(10**6)}"
        rows += [(10 * k, " ".join(a)), (10 * k + 1, " ".join(b))]
        seen.append(jaccard(plain_shingles(rows[-1][1]), plain_shingles(rows[-2][1])))
    rows += [(1000 + k, " ".join(words(r, 100) + passage)) for k in range(60)]
    base = words(r, 200)
    for k in range(60):
        b = list(base)
        b[r.randrange(200)] = f"y{k}"
        rows.append((2000 + k, " ".join(b)))
    return rows, seen


def test_planted_pairs(spark):
    rows, seen = planted()
    assert sum(0.8 <= x <= 0.95 for x in seen) > 15 and min(seen) < 0.8
    got = near.drop_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == plain_kept(rows)


def test_any_order_of_shingles_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(near, "OFTEN", 10**9)
    rows, _ = planted()
    got = near.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == plain_kept(rows)


def test_stage_null_and_repeated_ids(spark):
    import corpus_pipeline

    r = random.Random(4)
    t = [" ".join(words(r, 80)) for _ in range(9)]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (5, t[3]), (5, t[4]), (5, t[4]), (6, t[4] + " tail"), (7, t[0] + " tail"), (8, t[5])]
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((order(x["doc_id"]), x["text"]) for x in got) == sorted([(order(None), t[0]), (order(None), t[1]), (order(None), t[2]), (5, t[3]), (5, t[4]), (8, t[5])])


def test_fixture(docs, rows, empty):
    got = near.drop_similar(docs)
    assert got.columns == docs.columns
    assert sorted((order(x["doc_id"]), x["text"] or "") for x in got.collect()) == plain_kept(rows)
    assert near.drop_similar(empty).count() == 0
