"""Stages decide by row: null and repeated ids do not take other rows along."""

import random

from sparkweld.llm import decontaminate, near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng, n=60):
    return " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(2)


def test_clean_decides_by_row(spark):
    rng = random.Random(1)
    item, clean = text(rng, 30), [text(rng) for _ in range(4)]
    bad = [f"{text(rng, 20)} {item} {text(rng, 20)}" for _ in range(2)]
    docs = frame(spark, [(None, clean[0]), (None, clean[1]), (None, bad[0]), (7, clean[2]), (7, bad[1]), (8, clean[3])])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.clean(docs, bench)
    assert got.columns == docs.columns and sorted(r.text for r in got.collect()) == sorted(clean)


def test_keep_one_decides_by_row(spark):
    rng = random.Random(2)
    a, b, c, d = (text(rng) for _ in range(4))
    near_a = " ".join([*a.split()[:-1], "changed"])
    got = near.keep_one(frame(spark, [(1, a), (5, near_a), (5, b), (6, c), (6, c), (None, d), (None, d)])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (5, b), (6, c), (0, d), (0, d)])


NAMES = "_at _doc _tag _t _id _row _n _c _spans _salt _salts _gone _bad _bad_tag _key ids n_tokens decoded ids_sha256 seat fp h row id n a b".split()


def odd(spark, rows):
    """Documents with columns whose names the operators might use themselves."""
    x = frame(spark, rows)
    return x.selectExpr("*", *(f"concat('{c}', text) as `{c}`" for c in NAMES))


def test_clashing_names(spark):
    import public_tokenizers
    from sparkweld.llm import bpe, substrings

    rng = random.Random(4)
    shared, item = text(rng, 30), text(rng, 20)
    rows = [(1, f"{text(rng, 20)} {shared}"), (2, f"{text(rng, 20)} {shared} {text(rng, 9)}"), (3, f"{item} x"), (4, text(rng)), (5, None), (None, text(rng))]
    rows = [(i, t or "") for i, t in rows]
    docs, bench = odd(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")
    for out, n in ((decontaminate.clean(docs, bench), 5), (substrings.cut(docs), 6), (near.keep_one(docs), 6), (near.keep_one(docs.union(docs)), 7)):
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) == n and all(r["_at"] == "_at" + {i: t for i, t in rows}[r.doc_id] and r["seat"].startswith("seat") for r in got)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "text", "ids", "n_tokens"), digest=True)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "n_tokens_", "ids_", "ids_sha256", "decoded_sha256"]
    back = bpe.decode(out.withColumnRenamed("text", "decoded"), ranks, "ids_")
    assert back.columns[-1] == "decoded_" and all(r["decoded_"].decode() == r["decoded"] and r["ids"] == "ids" + r["decoded"] for r in back.collect())


def test_repeated_tables(spark):
    """A table united with itself: every row once more, and no other result."""
    from collections import Counter

    import public_tokenizers
    from sparkweld.llm import bpe, licenses, simhash, substrings

    rng = random.Random(6)
    shared, item = text(rng, 40), text(rng, 20)
    rows = [(i, f"{text(rng, 15)} {shared if i % 3 else item} {text(rng, 5)}") for i in range(30)] + [(30, ""), (None, shared), (None, "a")]
    docs, bench = frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for f in (
        lambda x: bpe.encode(x, ranks, public_tokenizers.PATTERN, ids=False, digest=True),
        lambda x: substrings.digest(x),
        lambda x: decontaminate.verdicts(*decontaminate.contamination(x, bench)).drop("row"),
        lambda x: simhash.near_duplicates(x),
        lambda x: licenses.scan(x),
        lambda x: substrings.cut(x),
        lambda x: decontaminate.clean(x, bench),
    ):
        once = Counter(f(docs).collect())
        assert Counter(f(docs.union(docs)).collect()) == Counter({k: 2 * n for k, n in once.items()})
