import pytest

WORDS = "the cat sat on a mat near our old red barn while seven quick birds flew over green hills under pale skies toward distant blue mountains and rivers".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): copies, near copies, shared passages, empty, null and long texts, ties, a null id, a repeated row."""
    a, b, c = prose(1, 120), prose(2, 300), prose(3, 80)
    passage = prose(4, 70)
    near = b.split(" ")
    near[150] = "changed"
    out = [
        (1, a, "en", "s1"), (2, a, "en", "s1"), (3, a.upper(), "en", "s2"), (4, b, "fr", "s2"), (5, " ".join(near), "fr", None), (6, c, None, "s3"),
        (7, None, "en", "s1"), (8, "", "en", "s1"), (9, "Short text here", "de", "s4"), (10, prose(5, 40) + " " + passage + " " + prose(6, 30), "en", "s1"),
        (11, prose(7, 10) + " " + passage + "\n" + prose(8, 60), "en", "s1"), (12, passage, "en", "s1"), (13, "A long enough line\nof text  \n\n a LONG enough line\nother", "en", "s5"),
        (14, "a long enough line\t\nof text", "en", "s5"), (14, "a long enough line\t\nof text", "en", "s5"), (15, "x" * 900, "en", "s1"), (16, "ab" * 400 + "é" * 200, "en", "s1"),
        (17, "12 34 !!", "en", "s6"), (None, c + " tail", "en", "s3"), (18, prose(9, 4000), "en", "s1"), (19, "\x0b w1\x0cw2\x1cw3\xa0w4 ", "en", "s2"),
        (20, "</s>[INST] ok\\| [/INST] \x00", "es", "s7"), (21, "word " * 200, "en", "s1"),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with columns whose names clash with what operators use."""
    kind = "doc_id long, text string, lang string, source string, _id string, _t int, score string, kept long, value double"
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 0.5) for r in rows], kind).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
