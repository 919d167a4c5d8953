"""Golden values of cleaning, keys and similarities, and properties of the pair functions."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sparkweld.functions import keys as k
from sparkweld.functions import similarity as sim
from sparkweld.functions import text as t

RAW = ["Smith & Sons, Pvt. Ltd.", "Café_Déjà-Vu™ LLC", "प्राइवेट 12", "ACME Corp. of India", "Zed  Co Ltd", None, ""]
GOLDEN = {
    "unicode": ["smith sons pvt ltd", "café_déjà vuTM llc", "प र इव ट 12", "acme corp of india", "zed co ltd", "", ""],
    "folded": ["smith sons pvt ltd", "cafe_deja vuTM llc", "प र इव ट 12", "acme corp of india", "zed co ltd", "", ""],
    "tail": ["smith and sons pvt ltd", "café_déjà vutm llc", "प र इव ट 12", "acme corp of india", "zed co ltd", "", ""],
    "ascii": ["smith sons pvt ltd", "caf d j vu llc", "12", "acme corp of india", "zed co ltd", "", ""],
    "and": ["smith and sons pvt ltd", "caf d j vu llc", "12", "acme corp of india", "zed co ltd", "", ""],
    "devanagari": ["smith sons pvt ltd", "caf d j vu llc", "प्राइवेट 12", "acme corp of india", "zed co ltd", "", ""],
    "expanded": ["smith sons private limited", "café_déjà vuTM limited liability company", "प र इव ट 12", "acme corporation of india", "zed company limited", "", ""],
    "ending": ["smith and sons", "caf d j vu llc", "12", "acme corp of india", "zed", "", ""],
}


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "name, f",
    [
        ("unicode", t.clean_unicode), ("folded", t.clean_folded), ("tail", t.clean_tail), ("ascii", t.clean_ascii), ("and", t.clean_and), ("devanagari", t.clean_devanagari),
        ("expanded", lambda c: t.name_expanded(t.clean_unicode(c))), ("ending", lambda c: t.without_ending(t.clean_and(c))),
    ],
)
def test_cleaning(spark, name, f):
    assert column(spark, RAW, f) == GOLDEN[name]


def test_canonical_forms(spark):
    assert column(spark, ["acme pvt ltd"], t.name_chained) == ["acme private limited limited"]
    assert column(spark, ["x road road y", "1 main street"], t.address_shortened) == ["x rd road y", "1 main st"]
    assert column(spark, ["12 st rd"], t.address_expanded) == ["12 street road"]
    assert column(spark, ["private limited", "acme private limited"], t.without_legal) == ["", "acme"]
    assert column(spark, ["limited", "a limited co ltd", "limited a"], t.without_ending) == ["limited", "a", "limited a"]
    assert column(spark, ["ACME co-1"], lambda c: t.compact(F.lower(c))) == ["acmeco1"]


def test_postal(spark):
    raw = ["12 MG Road, Bengaluru 560001, India", "Suite 4000, 94105-1234", "no digits", "Plot 7, 12345678901", None]
    assert column(spark, raw, k.postal) == ["560001", "1234", "", "", ""]
    assert column(spark, raw, lambda c: k.postal(c, 5, 6)) == ["560001", "94105", "", "", ""]
    assert column(spark, raw, lambda c: k.postal_word(t.clean_tail(c))) == ["india", "1234", "digits", "plot", ""]


def test_keys(spark):
    x = ["the acme foods of asia", "ab", ""]
    assert column(spark, x, lambda c: k.prefix(c, 6)) == ["theacm", "ab", ""]
    assert column(spark, x, lambda c: k.suffix(c, 4)) == ["asia", "ab", ""]
    assert column(spark, x, k.first_token) == ["acme", "", ""]
    assert column(spark, x, k.last_token) == ["asia", "", ""]
    assert column(spark, ["abcd", "ab", "", "a b cd"], lambda c: F.array_join(k.char_grams(c), ",")) == ["abc,bcd", "ab", "", "abc,bcd"]


PAIRS = [
    ("acme foods private limited", "acme food private limited", 96.153846, 33.333333, 78.260870),
    ("zed foods limited liability company", "zed foods", 25.714286, 66.666667, 20.689655),
    ("sons smith", "smith sons", 20.0, 100.0, 55.555556),
    ("ab", "ab", 100.0, 0.0, 100.0),
    ("abc", "", 0.0, 0.0, 0.0),
    ("", "", 100.0, 0.0, 0.0),
]


def test_similarities(spark):
    df = spark.createDataFrame([(i, *p[:2]) for i, p in enumerate(PAIRS)], "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    for x, y in ((a, b), (b, a)):
        got = df.select("i", sim.levenshtein_ratio(x, y), sim.token_jaccard(x, y), sim.gram_jaccard(x, y)).orderBy("i").collect()
        for r, p in zip(got, PAIRS):
            assert [round(v, 6) for v in r[1:]] == list(p[2:])


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_indel_family():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc d", k=rng.randrange(12))) for _ in range(2))
        assert sim.lcs(a, b) == slow_lcs(a, b)
        assert sim.indel(a, b) == pytest.approx(sim.indel(b, a))
        assert sim.partial(a, b) == pytest.approx(sim.partial(b, a))
        assert sim.token_set(a, b) == pytest.approx(sim.token_set(b, a))
    assert sim.indel("", "") == 100 and sim.partial("", "a") == 0 and sim.token_set("", "a") == 0
    assert sim.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert sim.partial("abc", "xxabcxx") == 100
    assert sim.indel("this is a test", "this is a test!") == pytest.approx(200 * 14 / 29)


def test_best_stretch_equals_all_stretches():
    def slow(a, b):
        if len(a) > len(b):
            a, b = b, a
        if not a:
            return 100.0 if not b else 0.0
        every = [sim.indel(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b))]
        if len(a) == len(b):
            every += [sim.indel(b, a[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b))]
        return max(every)

    rng = random.Random(7)
    for _ in range(1500):
        a, b = ("".join(rng.choices("abcde ", k=rng.randrange(14))) for _ in range(2))
        assert sim.partial(a, b) == pytest.approx(slow(a, b)), (a, b)


def test_fuzzy_columns(spark):
    df = spark.createDataFrame([("ab c", "ab d"), (None, "x")], "a string, b string")
    got = df.select(sim.indel_ratio("a", "b"), sim.token_set_ratio("a", "b"), sim.partial_ratio("a", "b")).collect()
    assert tuple(got[0]) == pytest.approx((sim.indel("ab c", "ab d"), sim.token_set("ab c", "ab d"), sim.partial("ab c", "ab d")))
    assert tuple(got[1]) == (0.0, 0.0, 0.0)


def test_word_class_is_letters_numbers_underscore():
    import re

    for c in range(0x3000):
        ch = chr(c)
        assert bool(re.match(r"\w", ch)) == (ch == "_" or unicodedata.category(ch)[0] in "LN"), hex(c)
