"""A document may have any number of languages."""

import random

import numpy as np

from mapgauge.llm import langid


def test_six_languages_in_a_document():
    r = random.Random(1)
    parts = [["ka", "lo", "mi"], ["tra", "ne", "gu"], ["esh", "ont", "yr"], ["vix", "qua", "zor"], ["bub", "dad", "pip"], ["wem", "huf", "jek"]]
    say = lambda p, n: " ".join("".join(r.choice(p) for _ in range(r.randrange(1, 4))) for _ in range(n)).encode()
    counts = np.zeros((langid.CODES, 6))
    for k, p in enumerate(parts):
        _, code, n = langid.trigrams([say(p, 4000)])
        counts[code, k] = n
    m = langid.Model(list("abcdef"), counts)
    shares, chosen = langid.infer(m, [b" ".join(say(p, 400) for p in parts), say(parts[0], 200), b"12 !"])
    assert chosen[0] == 6 and (shares[0] > 0.1).all()
    assert chosen[1] == 1 and shares[1, 0] == 1
