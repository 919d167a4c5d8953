"""Classifiers: held-out accuracy, and the defined results of odd cases."""

import random

import numpy as np
import pytest

from sparkweld.llm import language, quality, toxicity
from sparkweld.llm.common import table

SF = "/root/testdata/sf0.1"


def joined(spark, out):
    return out.join(table(spark, SF, "labels").withColumnRenamed("doc_id", "id"), "id").toPandas()


def test_quality_held_out(spark):
    x = joined(spark, quality.score(table(spark, SF, "documents"), table(spark, SF, "labels")))
    held = x[x.held_out]
    assert len(held) > 300 and (held.quality == held.predicted).mean() > 0.97 and x.score.between(0, 1).all()


def test_toxicity_held_out(spark):
    x = joined(spark, toxicity.score(table(spark, SF, "documents"), table(spark, SF, "labels")))
    held = x[x.held_out]
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    # some hundred toxic training texts: most English signs are found, those of languages with a few dozen texts are not
    above = (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None]).mean()
    assert above > 0.85 and (toxic.predicted == 1).mean() > 0.45 and (clean.predicted == 1).mean() < 0.02 and x.score.between(0, 1).all()


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    x = language.identify(docs).join(docs.select("doc_id", "lang").withColumnRenamed("doc_id", "id"), "id").toPandas()
    held = x[x.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.99 and x.score.between(0, 1).all()


def test_odd_cases(docs, rows, no_docs, labels):
    for f in (lambda d, t: quality.score(d, t), lambda d, t: toxicity.score(d, t), lambda d, t: language.identify(d)):
        out = f(docs, labels).collect()
        assert len(out) == len(rows) and all(r.score is not None and 0 <= r.score <= 1 for r in out)
        assert all(not r.held_out for r in out if r.id is None)
        assert f(no_docs, labels).count() == 0
        f(docs, labels.limit(0)).collect()
    assert all(r.score == 0.5 for r in quality.score(docs, labels.limit(0)).collect())
    assert all(r.score == 0.0 for r in toxicity.score(docs, labels.limit(0)).collect())
    lang = {r.id: r for r in language.identify(docs).collect()}
    assert all(lang[i].lang_pred == "und" and lang[i].score == 0 for i in (3, 7, 11))
    kept = quality.keep(docs, labels)
    assert kept.schema == docs.schema


def test_discriminant_equals_densities():
    rng = np.random.default_rng(1)
    d = len(quality.NAMES)
    x, y = rng.normal(size=(400, d)), np.arange(400) % 2
    x[y == 1] = x[y == 1] * 0.5 + 1
    m = quality.fit(x, y)
    pooled = np.diag(x.var(axis=0) + 1e-6)
    want = np.zeros(400)
    for k, sign in ((0, -1), (1, 1)):
        own = x[y == k]
        cov = (1 - quality.SHRINK) * np.cov(own, rowvar=False, bias=True) + quality.SHRINK * pooled
        r = x - own.mean(axis=0)
        want += sign * (np.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,ij->i", r @ np.linalg.inv(cov), r))
    assert np.allclose(m.difference(x), want)


def test_codewords_are_apart():
    for n in (2, 3, 5, 9, 30, 300):
        c = language.codewords(n)
        d = (c.shape[1] - c @ c.T) / 2
        assert d[~np.eye(n, dtype=bool)].min() >= max(8, c.shape[1] / 3) and (np.abs(c.sum(axis=0)) < n).all()


def test_one_and_many_languages():
    rng = random.Random(1)
    texts = [(" ".join("".join(rng.choices(chr(97 + k) + chr(98 + k) + chr(99 + k), k=5)) for _ in range(40))).encode() for k in range(12)]
    m = language.model_of([f"l{k:02d}" for k in range(12)], np.array([language.counts([t])[0] for t in texts], float))
    assert m.decode(language.counts(texts))[0] == m.names
    one = language.model_of(["xx"], language.counts([b"abc abc"]).astype(float))
    assert one.decode(language.counts([b"abc"]))[0] == ["xx"]


def test_windows_cover_the_text():
    for t in (b"", b"a", b"x" * 500, b"some words  and\nmore " * 40):
        assert b"".join(toxicity.windows(t)) == b" ".join(t.lower().split())


def test_copies_count_once():
    t = b"one two three four five six seven"
    assert toxicity.unlike([t, t, t + b" x", b"a b", b"a b", b""]) in ([t, b"a b", b""], [t, t + b" x", b"a b", b""])


@pytest.mark.parametrize("texts", [[], [b"a"], [b"a", b"b"]])
def test_tiny_training_sets(texts):
    s = toxicity.fit(texts, [i % 2 for i in range(len(texts))])
    assert all(0 <= p <= 1 for p in s.score([b"", b"words and words", b"\xff\xfe"]))
