"""The pipeline against a brute-force version of its filters, and the queries against their SQL."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from mapgauge.llm import queries
from mapgauge.llm.common import durable
from tests.helpers import same, views
from tests.llm.test_operators import plain_components, plain_fingerprint, raw


def test_stages(spark, docs, rows):
    kept = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    best = {}
    for i, t, *_ in kept:
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        best[k] = max(best.get(k, -(2**63)), -(2**63) if i is None else i)
    after_exact = set(best.values())
    fps = [(-(2**63) if i is None else i, plain_fingerprint(t)) for i, t, *_ in kept if (-(2**63) if i is None else i) in after_exact]
    comp = plain_components({i for i, _ in fps}, [(a, b) for a, x in fps for b, y in fps if (x ^ y).bit_count() <= 4])
    want = {"language_id": len(kept), "exact_dedup": len(after_exact), "near_dedup": len(set(comp.values()))}
    now, texts = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = durable(stage(spark, now, ""))
        assert now.columns == docs.columns
        if name in want:
            assert now.count() == want[name], name
        if name == "near_dedup":
            texts = {(r["doc_id"], w) for r in now.collect() for w in re.findall(rb"[^\x20\x09-\x0D]+", raw(r["text"]))}
    mixed = now.collect()
    assert {(r["doc_id"], w) for r in mixed for w in re.findall(rb"[^\x20\x09-\x0D]+", raw(r["text"]))} <= texts
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    by = defaultdict(int)
    for r in packed:
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= 2048 and {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), views(sf), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_gives_a_row_for_each_document(spark, sf, name):
    out = queries.queries()[name](spark, sf)
    n = out.count()
    assert n >= (0 if name in ("op1_chat",) else spark.read.parquet(f"{sf}/documents.parquet").count())
