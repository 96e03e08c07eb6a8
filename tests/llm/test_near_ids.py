"""Clean documents whose ids are null or repeat stay, and so do their neighbours."""

import random

import numpy as np
import pyarrow as pa
import pytest

from mapgauge.llm import simhash
from tests.llm.test_operators import clusters, order, plain_components


def test_null_and_repeated_ids(spark):
    r = random.Random(4)
    t = [" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(9)]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (5, t[3]), (5, t[4]), (5, t[4]), (6, t[4].upper()), (7, t[0]), (8, t[5])]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((order(x["doc_id"]), x["text"]) for x in got) == sorted([(order(None), t[0]), (order(None), t[1]), (order(None), t[2]), (5, t[3]), (5, t[4]), (8, t[5])])


@pytest.mark.parametrize("leaf", [2, 16])
def test_buckets_are_trees_of_one_index(leaf):
    r = np.random.default_rng(leaf)
    v = np.concatenate([clusters(k, 60 * k + 1, 3, 3) for k in range(6)] + [np.arange(3, dtype=np.uint64)])
    bucket = r.integers(0, 9, len(v))
    index = simhash.GrayIndex(v, bucket, leaf=leaf, fan=3)
    label = index.components(4)
    pairs = [(i, int(j)) for i in range(len(v)) for j in np.flatnonzero((np.bitwise_count(v ^ v[i]) <= 4) & (bucket == bucket[i]))]
    want = plain_components(range(len(v)), pairs)
    assert len({(label[i], want[i]) for i in range(len(v))}) == len(set(want.values())) == len(set(label.tolist()))
    assert index.visits > 0


def test_the_query_links_by_the_index_alone(spark, sf, monkeypatch):
    """Without the index's answers the query has no links between different fingerprints."""
    fps = simhash.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).select("fp").distinct()
    spread = simhash.buckets(fps, 4).toPandas()
    found, seen = simhash.GrayIndex.components, []

    def counted(self, most, chunk=1 << 14):
        out = found(self, most, chunk)
        seen.append((len(self.v), self.visits))
        return out

    monkeypatch.setattr(simhash.GrayIndex, "components", counted)
    links = pa.Table.from_batches(simhash._links(4)([pa.RecordBatch.from_pandas(spread[["mask", "value", "fp"]])]))
    several = spread.groupby(["mask", "value"]).size()
    assert seen[0][0] == several[several > 1].sum() and seen[0][1] >= (several > 1).sum() and len(links)
