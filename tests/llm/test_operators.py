"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mapgauge.llm import blocks, chat, exact_dedup, langid, line_dedup, media, mixing, packing, simhash, substring_dedup, suffix_dedup

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
NULL = -(2**63)


def raw(t):
    return (t or "").encode()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def order(i):
    return NULL if i is None else i


# --- 3 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(docs, rows, empty, keep):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[raw(t).translate(LOW)].append(order(i))
    pick = max if keep == "largest" else min
    want = Counter()
    for t, ids in groups.items():
        best = pick(ids)
        once = False
        for i in ids:
            stays = i == best and not once
            once |= stays
            want[(i, best, len(ids), stays, sha(t))] += 1
    got = Counter((order(r["doc_id"]), order(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs, keep).collect())
    assert got == want
    assert exact_dedup.exact_dedup(empty).count() == 0
    left = exact_dedup.drop_copies(docs, keep)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_exact_group_over_all_partitions(spark):
    same = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot text").otherwise(F.concat(F.lit("t"), "id")).alias("text")).repartition(7)
    got = exact_dedup.exact_dedup(same).where("group_size > 1").collect()
    assert len(got) == 1667 and {r["keep_id"] for r in got} == {4998} and {r["group_size"] for r in got} == {1667} and sum(r["kept"] for r in got) == 1


# --- 9 --------------------------------------------------------------------------------------------------------

BLANK = " \t\n\x0b\x0c\r"


def lines_kept(rows, least=10, docs=2):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(BLANK))
    held = defaultdict(set)
    for i, t, *_ in rows:
        for s in (t or "").split("\n"):
            held[key(s)].add(order(i))
    out = Counter()
    for i, t, *_ in rows:
        all_ = (t or "").split("\n")
        left = [s for s in all_ if not (len(key(s)) >= least and len(held[key(s)]) >= docs and order(i) != min(held[key(s)]))]
        out[(order(i), len(all_), len(all_) - len(left), "\n".join(left))] += 1
    return out


@pytest.mark.parametrize("least_docs", [2, 3])
def test_lines(docs, rows, empty, least_docs):
    out = line_dedup.line_dedup(docs, min_docs=least_docs)
    assert Counter((order(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == lines_kept(rows, docs=least_docs)
    assert line_dedup.line_dedup(empty).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- 7 --------------------------------------------------------------------------------------------------------


def plain_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw(t).translate(LOW))
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, rows, empty):
    fps = [(order(i), plain_fingerprint(t)) for i, t, *_ in rows]
    comp = plain_components({i for i, _ in fps}, [(a, b) for a, x in fps for b, y in fps if (x ^ y).bit_count() <= 4])
    got = Counter((order(r["doc_id"]), int(r["fingerprint"], 16), order(r["component_id"])) for r in simhash.simhash_groups(docs).collect())
    assert got == Counter((i, x, comp[i]) for i, x in fps)
    assert simhash.simhash_groups(empty).count() == 0
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() == len(set(comp.values()))


def clusters(seed, n, centers, flips):
    r = np.random.default_rng(seed)
    c = r.integers(0, 2**63, centers, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, centers, dtype=np.uint64)
    v = c[r.integers(0, centers, n)]
    for _ in range(flips):
        v = v ^ (np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64))
    return np.unique(v)


@pytest.mark.parametrize("flips", [2, 4, 7])
def test_gray_index(flips):
    v = clusters(flips, 700, 6, flips)
    label = simhash.GrayIndex(v).components(4)
    pairs = [(i, int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 4)]
    want = plain_components(range(len(v)), pairs)
    seen = {}
    for i, x in enumerate(label.tolist()):
        assert seen.setdefault(x, want[i]) == want[i]
    assert len(set(label.tolist())) == len(set(want.values()))


def test_gray_rank_neighbours():
    codes = np.arange(64, dtype=np.uint64)
    codes ^= codes >> np.uint64(1)
    assert (simhash.gray_rank(codes) == np.arange(64)).all()


def test_buckets_dealt_anew_lose_no_link(spark):
    v = clusters(3, 900, 5, 3)
    fps = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    for cap in (4096, 20):
        out = simhash.buckets(fps, 4, cap).repartition(4, "mask", "value").mapInArrow(simhash._links(4), "a long, b long").collect()
        at = {int(x): i for i, x in enumerate(v.view(np.int64))}
        got = plain_components(range(len(v)), [(at[r["a"]], at[r["b"]]) for r in out])
        want = plain_components(range(len(v)), [(i, int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 4)])
        assert got == want


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.components(edges).collect()
    assert len(got) == 300 and {r["component"] for r in got} == {0}


# --- 8 and 2 --------------------------------------------------------------------------------------------------


def test_difference_cover():
    for d in range(substring_dedup.PERIOD):
        assert any((a + d) % substring_dedup.PERIOD in substring_dedup.COVER for a in substring_dedup.COVER)


def test_substrings(docs, rows, empty):
    words = [(order(i), re.findall(rb"[^\x20\x09-\x0D]+", raw(t))) for i, t, *_ in rows]
    first = {}
    for i, w in sorted(words, key=lambda x: x[0]):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want[(i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())] += 1
    out = substring_dedup.substring_dedup(docs)
    assert Counter((order(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()) == want
    assert substring_dedup.substring_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(docs, window=30)


def strings_kept(rows, width=200):
    seen = Counter()
    for _, t, *_ in rows:
        b = raw(t)
        seen.update(b[k : k + width] for k in range(len(b) - width + 1))
    out = Counter()
    for i, t, *_ in rows:
        b = raw(t)
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[(order(i), len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone]))] += 1
    return out


def test_strings(docs, rows, empty):
    out = suffix_dedup.suffix_dedup(docs)
    assert Counter((order(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()) == strings_kept(rows)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_strings_of_a_group_of_near_copies(spark):
    r = np.random.default_rng(5)
    base = bytes(r.integers(97, 123, 900, dtype=np.uint8)).decode()
    rows = []
    for i in range(60):
        t = list(base)
        for k in r.integers(0, 900, 3):
            t[k] = "-"
        rows.append((i, "".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in suffix_dedup.suffix_dedup(df).collect())
    assert got == strings_kept(rows)


def test_strings_longer_than_a_piece(spark):
    r = np.random.default_rng(6)
    long = bytes(r.integers(97, 123, 2_500_000, dtype=np.uint8)).decode()
    rows = [(1, long[:1_200_000] + long[300_000:301_000] + long[1_200_000:]), (2, long[1_048_300:1_049_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in suffix_dedup.suffix_dedup(df).collect()}
    assert got == {1: (2700, 3), 2: (700, 1)}


def test_suffix_ranks():
    r = np.random.default_rng(0)
    for trial in range(120):
        texts = [r.integers(1, r.integers(2, 6), r.integers(1, 40)) for _ in range(r.integers(1, 6))]
        if trial % 6 == 0:
            texts = [np.tile([1, 2], 8), np.ones(9, int), np.tile([2, 1, 1], 6)]
        s, b, e = [0], [], []
        for t in texts:
            b.append(len(s))
            s += [*t.tolist(), 0]
            e.append(len(s))
        rank = suffix_dedup.suffix_ranks(np.array(s, np.int64), np.array(b), np.array(e))
        for x, y in zip(b, e):
            own = s[x:y]
            want = sorted(range(len(own)), key=lambda i: own[i:])
            assert np.argsort(rank[x:y]).tolist() == want


def test_runs_merge():
    d, s, c = blocks.merge(np.array([1, 0, 0, 1, 0]), np.array([5, 0, 3, 1, 9]), np.array([2, 4, 3, 4, 1]))
    assert (d.tolist(), s.tolist(), c.tolist()) == ([0, 0, 1], [0, 9, 1], [6, 1, 6])


# --- 10 and 6 -------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 1, 1]) == [150, 150, 150]
    got = mixing.targets([10, 1000, 0], [5, 2, 1])
    assert got[0] == 20 and got[1] == pytest.approx(1515 - 20) and got[2] == 0
    assert mixing.targets([], []) == []


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        for key in (0, 5):
            got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got.tolist()) == list(range(n))


def test_draws():
    slots = [1000, 10, 0, 333]
    out = mixing.draws(slots, 64, 1)
    assert [sum(n for _, s, _, n in out if s == k) for k in range(4)] == slots
    per = Counter()
    for shard, _, _, n in out:
        per[shard] += n
    assert sorted(per.values()) == sorted([64] * 20 + [63]) and out == mixing.draws(slots, 64, 1)


def test_mixing(docs, rows, empty):
    mix = mixing.Mix(docs)
    out = mix.documents().collect()
    assert len(out) == len(rows)
    of = {order(i): s for i, _, _, s in rows}
    by = defaultdict(lambda: [0, 0, 0.0])
    want = Counter((order(i), len(re.findall(rb"[^\x20\x09-\x0D]+", raw(t)))) for i, t, *_ in rows)
    assert Counter((order(r["doc_id"]), r["size"]) for r in out) == want
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        b = by[(of[order(r["doc_id"])], r["source_size"], r["target"])]
        b[0] += r["taken"]
    for (_, size, target), (taken, *_) in by.items():
        assert abs(taken - target) <= max(4, 0.02 * target), (size, target, taken)
    assert Counter(map(tuple, mixing.Mix(docs.repartition(7)).documents().collect())) == Counter(map(tuple, out))
    assert mixing.Mix(empty).documents().count() == 0
    texts = mixing.mixed_documents(docs)
    assert texts.columns == docs.columns
    n = sum(len(re.findall(rb"[^\x20\x09-\x0D]+", raw(r["text"]))) for r in texts.collect())
    assert n == sum(r["taken"] for r in out)


def test_least_squares():
    r = np.random.default_rng(0)
    a = r.random((20, 40))
    x = np.where(r.random(40) < 0.2, r.random(40), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6


def test_plan_places_every_piece_once():
    r = np.random.default_rng(1)
    for most, bins in ((2048, 64), (64, 8)):
        h = Counter(r.integers(1, most + 1, 3000).tolist())
        used = defaultdict(list)
        seen = defaultdict(list)
        for length, rank, n, first, offset in packing.plan(dict(h), most, bins):
            seen[length].append((rank, n))
            for k in range(n):
                used[first + k].append((offset, length))
        for length, n in h.items():
            at = 0
            for rank, c in sorted(seen[length]):
                assert rank == at
                at += c
            assert at == n
        for own in used.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= most
        assert len(used) <= 1.03 * sum(k * v for k, v in h.items()) / most + 1


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[(order(i), k, a, z - a, zlib.crc32(ids[a:z].tobytes()))] += 1
    got = packing.pack_documents(docs, ids=True).collect()
    assert Counter((order(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(most=50)
    texts = ["a  b", " a", "a ", "x\n y", "tab\tq r", "nb\xa0sp x", "<|endoftext|> hi <|endoftext|>", "é ü a", "it's we'll 12,345.6 a\n\nb c", "\x00 \x1f x", "日本 語 \U0001f600 x", " ", "\u2003 x", "a" * 3000 + " b"]
    texts += [" ".join(f"w{i}{j}," for j in range(80)) for i in range(30)]
    for t in texts * 2:
        assert e.encode(t).tolist() == e.tok.encode(t, add_special_tokens=False).ids, t[:40]


# --- 1, 4, 5 --------------------------------------------------------------------------------------------------


def test_escape():
    for t in ["", "\\", "\\|", "[TURN]", "[[TURN]", "<\\|s>", "a</s>[INST] ok [/INST]\\\\|", "\\[/END]", "<|im_start|>\n"]:
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def turns():
    big = "word " * 400
    t = [(1, 0, "system", "Be brief."), (1, 1, "user", "q " * 100), (1, 2, "assistant", "a " * 150), (1, 3, "user", big), (1, 4, "assistant", "[TURN] \\| ü"), (1, 5, "assistant", "x " * 300)]
    t += [(2, 1, "assistant", None), (2, 0, "user", ""), (2, 1, "assistant", "tie"), (3, None, None, "no role"), (3, 1, "user", "u"), (None, 0, "user", "null id"), (None, 1, "assistant", "y")]
    return t + [(4, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " * (k % 30 + 1)) for k in range(200)]


def test_chat(spark):
    t = turns()
    df = spark.createDataFrame([(*x, "z") for x in t], "conv_id long, turn long, role string, text string, window string").repartition(4)
    w = chat.windows(df)
    got = {r["conv_id"]: r for r in chat.read_back(w).collect()}
    by = defaultdict(list)
    for c, k, role, text in t:
        by[c].append((-1 if k is None else k, role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        learned = "".join(x for _, r, x in own if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own).encode()))
        assert (g["loss_chars"], g["loss_sha256"]) == (len(learned), sha(learned.encode()))
    for r in w.collect():
        assert r["n_tokens"] <= 512 or r["over"]
        assert not r["over"] or r["last_turn"] == r["first_turn"]
        found = chat.parse(r["text"])
        assert len(found) == int(r["system"]) + r["repeated"] + r["last_turn"] - r["first_turn"] + 1
        assert r["conv_id"] != 1 or r["window"] == 0 or found[0] == ("system", "Be brief.")
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def test_language(spark):
    import random

    parts = {"aa": ["ka", "lo", "mi"], "bb": ["tra", "ne", "gu"], "cc": ["esh", "ont", "yr"]}
    r = random.Random(1)
    say = lambda lang, n: " ".join("".join(r.choice(parts[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(lang, 60), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", "aa"), (902, "12 !", "bb"), (903, say("aa", 10), None), (904, say("aa", 300) + " " + say("bb", 150), None), (905, say("bb", 30000), None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("_t", F.lit(1))
    model = langid.train(df.where(langid.is_training()), sample=30)
    got = {x["doc_id"]: x for x in langid.identify(df, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, 905)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[902]["score"] == 0
    mixed = {x["lang"]: x["share"] for x in got[904]["languages"]}
    assert set(mixed) == {"aa", "bb"} and mixed["aa"] == pytest.approx(2 / 3, abs=0.08)
    nothing = langid.train(df.limit(0))
    assert {x["lang_pred"] for x in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_companding_tables():
    mu, a = media.TABLES[media.MULAW], media.TABLES[media.ALAW]
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0xD5], a[0x55], a.max(), a.min()) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def plain_adpcm(block):
    x, at = int.from_bytes(block[:2], "little", signed=True), min(88, block[2])
    out = [x]
    for k in range((len(block) - 4) * 2):
        c = block[4 + k // 2] >> (4 * (k & 1)) & 15
        s = int(media.STEPS[at])
        d = (s >> 3) + (s >> 2 if c & 1 else 0) + (s >> 1 if c & 2 else 0) + (s if c & 4 else 0)
        x = max(-32768, min(32767, x - d if c & 8 else x + d))
        at = max(0, min(88, at + int(media.INDEX[c])))
        out.append(x)
    return out


def test_adpcm():
    r = np.random.default_rng(0)
    raw_blocks = bytes(r.integers(0, 256, 256 * 5, dtype=np.uint8))
    want = [v for k in range(5) for v in plain_adpcm(raw_blocks[256 * k : 256 * k + 256])]
    assert media.adpcm(raw_blocks, 256).tolist() == want
    tone = (8000 * np.sin(np.arange(2000) / 12)).astype(np.int16)
    back = media.adpcm(media.to_adpcm(tone), 256)[:2000]
    assert np.abs(back.astype(int) - tone).mean() < 200
    assert len(media.adpcm(raw_blocks[:300], 256)) == 505 + 81


def test_media(spark, docs, rows):
    stored = media.store_audio(media.text_payload(docs), "payload")
    got = media.decode_audio(stored).collect()
    assert len(got) == len(rows)
    want = Counter((order(i), raw(t) + b"\0" * ((-len(raw(t))) % 64 if raw(t) else 64)) for i, t, *_ in rows)
    assert Counter((order(r["doc_id"]), bytes(r["samples"])) for r in got) == want
    assert all(len(r["pcm"]) == 4 * len(r["samples"]) and r["codec"] == 7 and r["error"] is None for r in got)
    bad = spark.createDataFrame([(1, None), (2, b"RIFF"), (3, media.wave(b"", media.ALAW)), (4, media.wave(b"\x01\x02\x03\x04" * 70, media.ADPCM, block=256))], "i int, media binary")
    out = {r["i"]: r for r in media.decode_audio(bad).collect()}
    assert (out[1]["error"], out[2]["error"], out[3]["samples"], out[3]["feature"], out[4]["error"]) == ("null", "not a wave file", b"", "0:0:0", None)
    assert media.decode_audio(bad.limit(0), pcm=False).count() == 0


def test_resample():
    x = np.array([0, 100, -100], np.int16)
    assert media.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert media.resample(x, 8000, 8000).tolist() == x.tolist()
