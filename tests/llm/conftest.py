import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, row string, id int"


def corpus(seed=5, n=60):
    """Small texts with copies, near copies, shared passages, every kind of odd text, and columns with clashing names."""
    rng = random.Random(seed)
    words = ["the", "of", "and", "ein", "und", "é", "中", "idiot", "x", "|", "a1", "B2", "C-3", "naïve"] + ["w%d" % i for i in range(300)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    passage, out = text(40), []
    for i in range(n):
        kind = rng.randrange(8)
        t = text(rng.randrange(1, 120))
        if kind == 0 and out:
            t = rng.choice(out)
        elif kind == 1 and out and rng.choice(out):
            old = (rng.choice([x for x in out if x] or ["a"])).split(" ")
            old[rng.randrange(len(old))] = "changed"
            t = " ".join(old)
        elif kind == 2:
            t = text(20) + "\n" + passage[rng.randrange(30) :] + "\t " + text(5)
        out.append(t)
    out[3], out[7], out[11], out[13] = None, "", " \n\t ", "12 !?"
    out[17] = text(20000)
    out[19] = " ".join(["de"] * 500)
    out[23] = out[23] + "  x" if out[23] else " y"
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", None if t is None else len(t), "h", "r", 1) for i, t in enumerate(out)]
    rows += [rows[5], (5, "another text under an id that is taken", "en", "s", 3, "h", "r", 1), (None, rows[9][1], "en", "s", 1, "h", "r", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0), "x") for i in range(60)] + [(0, None, None, "y"), (None, 1, 1, "z")], "doc_id long, quality int, toxic int, text string")
