"""One text of 30 MB in every operator: right answers, and memory of the Python side far below an executor's."""

import hashlib
import re
import subprocess
import sys

import numpy as np
import pytest

from mapgauge.llm import chat, exact_dedup, langid, line_dedup, media, mixing, near, packing, simhash, substring_dedup, suffix_dedup

MAKE = """
import numpy as np
r = np.random.default_rng(1)
words = np.array([f"w{i:x}" for i in range(50000)])
text = " ".join(words[r.integers(0, 50000, 30_000_000 // 6)].tolist())
text = text[:10_000_000] + "\\n" + text[10_000_000:30_000_000]
"""

ALONE = {
    "langid": "from mapgauge.llm import langid; m = langid.Model(['a', 'b'], np.ones((langid.CODES, 2))); langid.infer(m, [text.encode()])",
    "media": "from mapgauge.llm import media; w = media.unwave(media.wave(text.encode(), media.ADPCM, block=64)); x = media.expand([(w[0], w[2], w[3])])[0]; y = media.resample(x, 8000, 16000); media.feature(y)",
    "packing": "from mapgauge.llm import packing; packing.Encoder().encode(text)",
    "packing_lines": "from mapgauge.llm import packing; packing.Encoder().encode(text.replace(' w1', ' \\n w1'))",
    "simhash": "from mapgauge.llm import simhash; simhash.fingerprint(text.encode())",
    "near": "from mapgauge.llm import near; near.shingles(text.encode())",
    "chat": "from mapgauge.llm import chat; chat.unescape(chat.escape(text)); chat.count_tokens([text])",
}


@pytest.mark.parametrize("name", sorted(ALONE))
def test_memory_of_a_worker(name):
    code = MAKE + "import resource\nbefore = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n" + ALONE[name] + "\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[-1])
    assert grown < 1200, grown


@pytest.fixture(scope="module")
def long(spark):
    space: dict = {}
    exec(MAKE, space)
    text = space["text"]
    df = spark.createDataFrame([(1, text, "en", "s"), (2, "short text of a few words", "en", "s")], "doc_id long, text string, lang string, source string").repartition(2)
    return df, text


def test_exact_line_mix(long):
    df, text = long
    got = {r["doc_id"]: r["text_sha256"] for r in exact_dedup.exact_dedup(df).collect()}
    assert got[1] == hashlib.sha256(text.encode()).hexdigest()
    assert {r["doc_id"]: r["n_lines"] for r in line_dedup.line_dedup(df).select("doc_id", "n_lines").collect()} == {1: 2, 2: 1}
    n = len(text.split())
    assert {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.Mix(df).documents().collect()}[1][0] == n


def test_fingerprints_and_languages(long):
    df, text = long
    assert simhash.simhash_groups(df).count() == 2 and near.drop_similar(df).count() == 2
    model = langid.train(df)
    assert [r["lang_pred"] for r in langid.identify(df, model).select("lang_pred").collect()] == ["en", "en"]


def test_media_and_pieces(long):
    df, text = long
    stored = media.store_audio(media.text_payload(df), "payload")
    got = {r["doc_id"]: r["h"] for r in media.decode_audio(stored).selectExpr("doc_id", "sha2(samples, 256) as h").collect()}
    raw = text.encode()
    assert got[1] == hashlib.sha256(raw + b"\0" * (-len(raw) % 64)).hexdigest()
    found = packing.pieces(df).where("_id = 1").agg({"length": "sum"}).first()[0]
    assert found == len(packing.Encoder().encode(text)) + 1


def test_repeats(long):
    df, text = long
    words = re.findall(r"\S+", text)
    more = df.sparkSession.createDataFrame([(3, " ".join(words[1000:1200]))], "doc_id long, text string")
    both = df.select("doc_id", "text").unionByName(more)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(both).select("doc_id", "n_words", "n_removed").collect()}
    assert got[1] == (len(words), 0) and got[3] == (200, 200)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(both).select("doc_id", "n_removed").collect()}
    size = len(" ".join(words[1000:1200]))
    assert got[3] == size and got[1] == size


def test_turns(long):
    df, text = long
    turns = df.selectExpr("1L as conv_id", "doc_id as turn", "'assistant' as role", "text")
    got = chat.read_back(chat.windows(turns)).collect()
    assert got[0]["n_turns"] == 2 and got[0]["loss_chars"] == len(text) + 25


def test_segments_are_encoded_as_the_whole():
    short, whole = packing.Encoder(segment=7), packing.Encoder()
    texts = ["a b c d e f g h i j k l m n", "a  b   c d\n e f \t g  h i", "x" * 50 + " y z" * 9, "日本 語 の 文 " * 5, "it's we'll don't 12,345.6 a\n\nb c, d. e", " a b　c d e\x1cf g h i j k", " lead and trail ", "<|endoftext|> a b <|endoftext|> c d"]
    for t in texts:
        want = whole.tok.encode(t, add_special_tokens=False).ids
        assert short.encode(t).tolist() == want and whole.encode(t).tolist() == want, t


def test_trigrams_in_parts():
    r = np.random.default_rng(3)
    texts = [bytes(r.choice(np.frombuffer(b"ab \n\xc3\xa9z.", np.uint8), n)) for n in (0, 1, 2, 3, 50, 400, 7)]
    want = langid.trigrams(texts)
    plain = {}
    for i, t in enumerate(texts):
        c = [0, *langid._CLASS[list(t)].tolist(), 0] if t else []
        for k in range(1, len(c) - 1):
            if c[k]:
                key = (i, c[k - 1] << 12 | c[k] << 6 | c[k + 1])
                plain[key] = plain.get(key, 0) + 1
    assert dict(zip(zip(*(x.tolist() for x in want[:2])), want[2].tolist())) == plain
    for most in (1, 3, 10, 64):
        assert all((a == b).all() for a, b in zip(want, langid.trigrams(texts, most)))
