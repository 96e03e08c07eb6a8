"""The mix against a plain version, and repeated rows of several sources in every order."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mapgauge.llm import mixing
from tests.llm.conftest import prose
from tests.llm.test_operators import order, raw

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def many(spark):
    """Sources of many blocks, of a block, of a few words; null source, text and id; a long text; repeated rows."""
    out = [(i, prose(i, 20 + i % 300), f"s{i % 3}") for i in range(300)]
    out += [(400, "only four words here", "tiny"), (401, prose(401, 256), "block"), (402, prose(402, 257), "over"), (403, prose(403, 30000), "s2"), (404, None, "s0"), (405, "", None)]
    out += [(None, prose(5, 50), None), (None, prose(6, 60), None), (7, prose(7, 40), "s1"), (7, prose(7, 40), "s1"), (7, prose(7, 40), "s2")]
    return spark.createDataFrame(out, "doc_id long, text string, source string").repartition(5), out


def test_last_slot_is_cut_at_the_target():
    for size, block in ((1, 4), (4, 4), (5, 4), (23, 4), (1000, 256), (257, 256)):
        for source in (0, 3):
            blocks = -(-size // block)
            for words in range(0, 2 * size + 1, max(1, size // 50)):
                slots, cut = mixing.slots_for(words, size, block, source, 7)
                i = np.arange(slots)
                got = mixing.permute(i % blocks, np.full(slots, blocks), mixing.turn_key(np.full(slots, source), i // blocks, 7))
                length = np.where(got == blocks - 1, size - (blocks - 1) * block, block)
                if slots:
                    assert length[:-1].sum() < words and cut >= 1
                    length[-1] = min(length[-1], cut)
                assert length.sum() == words


def test_permutation_is_undone():
    for n in (1, 2, 5, 64, 1000):
        i, k = np.arange(n), np.full(n, 9)
        assert (mixing.unpermute(mixing.permute(i, np.full(n, n), k), np.full(n, n), k) == i).all()


def test_plain_mix(many):
    docs, rows = many
    mix = mixing.Mix(docs, shard_slots=64)
    placed, slots = mix.rows.collect(), mix.slots().collect()
    sources = {r["_s"]: r for r in mix.sources.collect()}
    # every source is a strip of words, one document after another
    strip = defaultdict(dict)
    for r in placed:
        for w in range(r["_size"]):
            assert r["_start"] + w not in strip[r["_s"]]
            strip[r["_s"]][r["_start"] + w] = (r["_id"], r["_th"], r["_rh"], r["_start"])
    assert all(sorted(v) == list(range(sources[k]["source_size"])) for k, v in strip.items())
    # slots: numbered without gaps, every block at most once a pass, shards full but the last
    taken, by = Counter(), defaultdict(list)
    for x in slots:
        by[x["_s"]].append(x)
        own, a = strip[x["_s"]], 256 * x["_block"]
        for w in range(a, min(a + 256, len(own), a + x["_most"])):
            taken[own[w]] += 1
    assert sum(s["source_size"] > 5000 for s in sources.values()) >= 3
    for k, own in by.items():
        assert sorted(x["slot"] for x in own) == list(range(len(own)))
        assert max(Counter((x["turn"], x["_block"]) for x in own).values()) == 1
        assert sum(n for d, n in taken.items() if d in set(strip[k].values())) == round(sources[k]["target"])
    full = Counter(x["shard"] for x in slots)
    assert sorted(full) == list(range(len(full))) and all(n == 64 for s, n in full.items() if s < len(full) - 1)
    want = Counter((order(r["_id"]), r["_size"], sources[r["_s"]]["source_size"], taken[(r["_id"], r["_th"], r["_rh"], r["_start"])] if r["_size"] else 0) for r in placed)
    got = mix.documents().collect()
    assert Counter((order(r["doc_id"]), r["size"], r["source_size"], r["taken"]) for r in got) == want
    assert Counter((order(i), len(WORDS.findall(raw(t)))) for i, t, _ in rows) == Counter((order(r["doc_id"]), r["size"]) for r in got)


def test_texts_of_the_mix(many):
    docs, rows = many
    mix = mixing.Mix(docs)
    taken = Counter()
    for r in mix.documents().collect():
        taken[order(r["doc_id"])] += r["taken"]
    got = Counter()
    whole = defaultdict(list)
    for i, t, s in rows:
        whole[(order(i), s)].append(WORDS.findall(raw(t)))
    for r in mixing.mixed_documents(docs).collect():
        own = WORDS.findall(raw(r["text"]))
        got[order(r["doc_id"])] += len(own)
        assert any(Counter(own) <= Counter(w) for w in whole[(order(r["doc_id"]), r["source"])])
    assert got == +taken


def test_groups_of_shards(many, monkeypatch):
    docs, _ = many
    want = mixing.Mix(docs, shard_slots=8).documents().collect()
    monkeypatch.setattr(mixing, "GROUP", 3)
    mix = mixing.Mix(docs, shard_slots=8)
    n = Counter(x["shard"] for x in mix.slots().collect())
    assert all(v == 8 for s, v in n.items() if s < max(n)) and len(n) > 9
    assert Counter(map(tuple, mix.documents().collect())) == Counter(map(tuple, want))


def test_repeated_rows_of_several_sources(spark):
    text = prose(1, 300)
    base = [(1, text, "a"), (1, text, "b"), (1, text, "c"), (1, text, "c"), (None, "", "a"), (None, None, "b")]
    seen = set()
    for p in list(itertools.permutations(range(4)))[::5]:
        rows = [base[i] for i in p] + base[4:]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
        words = defaultdict(int)
        for r in mixing.mixed_documents(df).collect():
            words[r["source"]] += len(WORDS.findall(raw(r["text"])))
        took = mixing.Mix(df).documents().collect()
        assert words == {"a": 600, "b": 600, "c": 600}
        assert sorted((r["source_size"], r["taken"]) for r in took if r["size"]) in ([(300, 600), (300, 600), (600, 0), (600, 600)], [(300, 600), (300, 600), (600, 300), (600, 300)])
        seen.add(tuple(sorted((r["source"], raw(r["text"])) for r in mixing.mixed_documents(df).collect())))
    assert len(seen) == 1
