"""Queries of the classifiers against plain Python that follows their definitions word by word, on a small fixture."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from sparkweld.llm import language, quality, toxicity

WORDS = {"en": "the of and that with this from have".split(), "de": "der die und das nicht ist ein mit".split(), "fr": "le la les des est dans pour une".split()}


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Tables on disk as the queries read them, and their rows."""
    rng, folder, docs, labels = random.Random(12), tmp_path_factory.mktemp("models"), [], []
    for i in range(260):
        lang = rng.choice(list(WORDS))
        w = [rng.choice(WORDS[lang]) + rng.choice(["", "", "x%d" % rng.randrange(40)]) for _ in range(rng.randrange(3, 60))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if not good:
            w = [x.upper() + rng.choice(["!", "|", "$$", "7"]) for x in w for _ in range(rng.randrange(1, 3))]
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["worthless", "disgusting", "pathetic"])
        t = " ".join(w)
        docs.append((i, None if i == 7 else "" if i == 8 else "12 34 !?" if i == 9 else t, None if i == 5 else lang, "s", len(t)))
        if i % 9:
            labels.append((i, int(good), int(toxic)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, labels


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def slow_statistics(text):
    b, words, lines = (text or "").encode(), (text or "").encode().split(), [x for x in (text or "").encode().split(b"\n") if x]
    n, w, c = max(1, len(b)), max(1, len(words)), Counter(b)
    of = lambda chars: sum(c[x] for x in chars)
    symbols = [x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,"]
    same = sum(1 for x, y in zip(words, words[1:]) if x == y)
    return [
        math.log(1 + len(words)), math.log(1 + (n - w) / w), math.sqrt(of(range(65, 91)) / n), math.sqrt(of(range(48, 58)) / n), math.sqrt(of(symbols) / n),
        math.sqrt(c[124] / w), math.log((len(set(words)) + 1) / (w + 1)), math.sqrt(same / w), math.sqrt(1 - len(set(lines)) / max(1, len(lines))),
        math.log(1 + w / max(1, len(lines))), math.sqrt(of(b".,!?") / w), math.sqrt(of(range(128, 256)) / n),
    ]


def test_quality_query(spark, fixture):
    folder, docs, labels = fixture
    label = {i: q for i, q, _ in labels if fold(i, 5) != 0}
    x = {i: np.array(slow_statistics(t)) for i, t, *_ in docs}
    rows = [(x[i], y) for i, y in label.items()]
    every = np.array([a for a, _ in rows])
    spread = np.diag(((every - every.mean(axis=0)) ** 2).mean(axis=0) + 1e-6)
    density = []
    for k in (0, 1):
        own = np.array([a for a, y in rows if y == k])
        mean = own.mean(axis=0)
        cov = 0.95 * sum(np.outer(a - mean, a - mean) for a in own) / len(own) + 0.05 * spread
        inverse, size = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        density.append(lambda a, m=mean, v=inverse, s=size, p=len(own) / len(rows): math.log(p) - 0.5 * s - 0.5 * (a - m) @ v @ (a - m))
    z = lambda a: math.asinh(density[1](a) - density[0](a))
    points = [(z(a), y) for a, y in rows]
    slope = offset = 0.0
    for _ in range(60):  # Newton steps of the calibration
        g, h = np.array([1e-3 * slope, 1e-3 * offset]), np.eye(2) * 1e-3
        for v, y in points:
            p, u = 1 / (1 + math.exp(-slope * v - offset)), np.array([v, 1.0])
            g, h = g + (p - y) * u, h + p * (1 - p) * np.outer(u, u)
        slope, offset = np.array([slope, offset]) - np.linalg.solve(h, g)
    got = {r.doc_id: r for r in quality.query(spark, folder).collect()}
    assert len(got) == len(docs)
    for i, *_ in docs:
        want = 1 / (1 + math.exp(-max(slope, 0) * z(x[i]) - offset))
        assert abs(got[i].score - want) < 1e-6 and got[i].held_out == (fold(i, 5) == 0) and got[i].predicted == int(got[i].score >= 0.3)


def test_language_query(spark, fixture):
    folder, docs, _ = fixture

    def grams(text):
        clean = re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").encode().lower()).strip()
        data, out = b" " + clean + b" ", Counter()
        for n in (2, 3, 4):
            for i in range(len(data) - n + 1):
                code = n * 0x9E3779B1 & 0xFFFFFFFF
                for b in data[i : i + n]:
                    code = (code ^ b) * 0x85EBCA6B & 0xFFFFFFFF
                    code ^= code >> 13
                out[code % 4096] += 1
        return out

    sums = {}
    for i, t, lang, *_ in docs:
        if t is not None and lang is not None and fold(i, 3) != 1:
            sums.setdefault(lang, Counter()).update(grams(t))
    names = sorted(sums)
    share = [[(sums[n][b] + 0.5) / (sum(sums[n].values()) + 2048) for b in range(4096)] for n in names]
    code = language.codewords(len(names))
    got = {r.doc_id: r for r in language.query(spark, folder).collect()}
    for i, t, *_ in docs:
        assert got[i].held_out == (fold(i, 3) == 1)
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        g, loss = grams(t), [0.0] * len(names)
        total = sum(g.values())
        for k in range(code.shape[1]):
            mean = lambda b, s: sum(share[j][b] for j in range(len(names)) if code[j, k] == s) / sum(code[:, k] == s)
            margin = math.tanh(sum(n * math.log(mean(b, 1) / mean(b, -1)) for b, n in g.items()) / total) * 8 * min(1, math.sqrt(total / 50))
            for j in range(len(names)):
                loss[j] += math.log(1 + math.exp(-margin * code[j, k]))
        best = min(range(len(names)), key=loss.__getitem__)
        assert got[i].lang_pred == names[best] and abs(got[i].score - 1 / sum(math.exp(loss[best] - x) for x in loss)) < 1e-6


def test_toxicity_query(spark, fixture):
    folder, docs, labels = fixture
    label = {i: t for i, _, t in labels if fold(i, 3) != 1}
    known = sorted((i, t or "", label[i]) for i, t, *_ in docs if i in label)
    model = toxicity.fit([t.encode() for _, t, _ in known], [y for *_, y in known])
    assert b"worthless" in model.toxic and b"worthless" not in model.ordinary
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, min_match=5, window_log=15, chain_log=14, hash_log=14, search_log=3, target_length=8,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )

    def size(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(window))

    got = {r.doc_id: r for r in toxicity.query(spark, folder).collect()}
    assert len(got) == len(docs)
    right = Counter()
    truth = {i: t for i, _, t in labels}
    for i, t, *_ in docs:
        text = " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()).encode()
        gains, at = [], 0
        while at < len(text):
            end = text.find(b" ", at + 32, at + 64)
            end = end + 1 if end >= 0 else min(len(text), at + 64)
            gains.append(size(text[at:end], model.ordinary) - size(text[at:end], model.toxic))
            at = end
        n, over = len(gains), [sum(g >= k for g in gains) for k in (2, 3, 4, 5, 6, 8)]
        x = [*map(math.log1p, over), *(math.sqrt(o / max(1, n)) for o in over), min(12, max([0, *gains])), math.log1p(n), 1.0]
        want = 1 / (1 + math.exp(-float(np.dot(x, model.weights))))
        assert abs(got[i].score - want) < 1e-9 and got[i].held_out == (fold(i, 3) == 1) and got[i].predicted == int(got[i].score >= 0.7)
        if fold(i, 3) == 1 and i in truth:
            right[truth[i] == got[i].predicted] += 1
    assert right[True] > 0.9 * (right[True] + right[False])
