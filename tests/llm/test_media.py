"""Damaged files give an error row; formats are mixed; the query's digests against a plain version."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from mapgauge.llm import media, queries
from tests.llm.test_operators import plain_adpcm, raw


def fmt(tag=7, channels=1, rate=8000, block=1, bits=8, size=16):
    return b"fmt " + struct.pack("<I", size) + struct.pack("<HHIIHH", tag, channels, rate, rate, block, bits)[:size]


def riff(body):
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


DATA = b"data" + struct.pack("<I", 4) + b"abcd"
DAMAGED = {
    "cut format": riff(fmt(size=8)), "no format": riff(DATA), "no rate": riff(fmt(rate=0) + DATA), "no block": riff(fmt(17, block=0, bits=4) + DATA), "small block": riff(fmt(17, block=4, bits=4) + DATA),
    "stereo": riff(fmt(channels=2) + DATA), "odd pcm": riff(fmt(1, bits=16) + b"data" + struct.pack("<I", 3) + b"abc\0"), "unknown": riff(fmt(99) + DATA), "cut data": riff(fmt() + DATA)[:-2],
    "lying size": riff(fmt() + b"data" + struct.pack("<I", 2**32 - 1)), "empty": b"", "no data": riff(fmt()), "cut head": riff(fmt())[:22],
}


def test_damaged_files(spark):
    good = media.wave(b"abcd", media.ALAW)
    rows = [*DAMAGED.items(), ("good", good), *[(f"cut {k}", good[:k]) for k in range(len(good))]]
    got = {r["name"]: r for r in media.decode_audio(spark.createDataFrame(rows, "name string, media binary").coalesce(1)).collect()}
    assert len(got) == len(rows)
    for name, r in got.items():
        assert (r["error"] is None) == (name == "good") and (r["samples"] is None) == (name != "good"), name
    assert bytes(got["good"]["samples"]) == b"abcd"


def test_mixed_formats(spark):
    r = np.random.default_rng(0)
    data = [bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (640, 64, 0, 300, 64 * 9, 1)]
    rows = [(f"{t}-{b}-{i}", media.wave(x, t, block=b)) for i, x in enumerate(data) for t, b in ((7, 1), (6, 1), (17, 64), (17, 256))]
    got = {x["name"]: np.frombuffer(x["pcm"], "<i2").tolist() for x in media.decode_audio(spark.createDataFrame(rows, "name string, media binary").coalesce(1), to_rate=8000).collect()}
    for i, x in enumerate(data):
        for t in (6, 7):
            assert got[f"{t}-1-{i}"] == media.TABLES[t][list(x)].tolist()
        for b in (64, 256):
            want = [v for k in range(0, len(x), b) if len(x[k : k + b]) >= 4 for v in plain_adpcm(x[k : k + b])]
            assert got[f"17-{b}-{i}"] == want


def test_decoding_in_parts():
    r = np.random.default_rng(2)
    data = bytes(r.integers(0, 256, 64 * 11 + 20, dtype=np.uint8))
    whole = media.adpcm(data, 64)
    assert media.adpcm(data, 64, chunk=3).tolist() == whole.tolist()
    for to in (16000, 11025, 4000):
        assert media.resample(whole, 8000, to, chunk=7).tolist() == media.resample(whole, 8000, to).tolist()
    assert media.feature(whole, chunk=5) == media.feature(whole)


def test_query_against_a_plain_version(spark, sf):
    texts = {r["doc_id"]: raw(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.queries()["op5_media"](spark, sf).collect()
    assert len(got) == len(texts) and {r["codec"] for r in got} == {6, 7, 17}
    for r in got[:60]:
        t = texts[r["doc_id"]]
        p = t + b"\0" * (-len(t) % 64 if t else 64)
        tag = (7, 6, 17)[zlib.crc32(p) % 3]
        stored = media.wave(p, tag, block=64)
        pcm = [int(v) for v in media.TABLES[tag][list(p)]] if tag != 17 else [v for k in range(0, len(p), 64) for v in plain_adpcm(p[k : k + 64])]
        n = len(pcm) * 2
        wide = [(pcm[k // 2] * (1 if k % 2 else 2) + (pcm[min(k // 2 + 1, len(pcm) - 1)] if k % 2 else 0)) // 2 for k in range(n)]
        signs = sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:]))
        want = (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{max(map(abs, wide))}:{sum(x * x for x in wide) // n}:{signs}", 2 * n, hashlib.sha256(np.array(wide, '<i2').tobytes()).hexdigest())
        assert tuple(r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256")) == want


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, b"x", "old", b"old")], "i int, payload binary, codec string, media binary")
    out = media.decode_audio(media.store_audio(df, "payload"))
    assert out.columns == ["i", "payload", "media", "samples", "codec", "rate", "feature", "error", "pcm"] and bytes(out.first()["samples"]) == b"x"


@pytest.mark.parametrize("n", [0, 3, 4, 5, 64, 65, 300])
def test_sample_counts(n):
    assert media.adpcm_samples(n, 64) == len(media.adpcm(bytes(n), 64))
