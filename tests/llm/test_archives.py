"""WARC archives and license scans."""

import hashlib
import random
import struct
from collections import Counter

import pytest
import zstandard

from sparkweld.llm import licenses, warc
from sparkweld.llm.decontaminate import words_of

BIG = "<p>same payload é</p>" * 10
PAGES = [(5, "http://a/5", BIG), (2, "http://a/2", BIG), (9, None, BIG), (1, "http://a b\r\n/1", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (2, "http://a/2", BIG), (None, "n", BIG)]
PAGES += [(100 + i, f"http://x/{i}", "page %d " % i * 50) for i in range(200)] + [(7, "long", "x" * 300_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, bytes int").repartition(4)


def test_round_trip(spark, pages, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/a"
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    monkeypatch.setattr(warc, "TRAIN_BYTES", 5000)
    manifest = warc.write(pages, folder)
    assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES) and manifest.count() > 3
    got = Counter()
    for r in warc.read(spark, f"{folder}/archives").collect():
        got[(r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest)] += 1
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    want = Counter()
    for i, _, html in PAGES:
        b = (html or "").encode()
        visit = len(b) >= 100 and html == BIG and i != 2
        want[(f"<urn:page:{'' if i is None else i}>", "revisit" if visit else "response", "<urn:page:2>" if visit else None, len(b), hashlib.sha256(b).hexdigest())] += 1
    assert got == want


def test_empty_table(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/e"
    warc.write(pages.limit(0), folder)
    assert warc.read(spark, f"{folder}/archives").count() == 0


def sample(trained=None):
    r = [warc.record(i, "u", b"abc%d" % i, hashlib.sha256(b"abc%d" % i).hexdigest(), None, 4) for i in range(5)]
    return b"".join(warc.archive(r, trained)), r


def test_frames_with_dictionaries():
    rng = random.Random(1)
    trained = warc.dictionary([bytes(rng.choices(b"abcdefgh <>/", k=400)) + b"<html><body>common</body>" * 8 for _ in range(200)])
    for d in (None, trained):
        data, records = sample(d)
        assert [x for _, x in warc.frames(data)] == records
        assert [warc.parse(x)["payload"] for x in records] == [b"abc%d" % i for i in range(5)]
    data, records = sample(trained)
    packed = zstandard.compress(trained)
    again = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + data[8 + len(trained) :]
    assert [x for _, x in warc.frames(again)] == records
    assert list(warc.frames(b"")) == []


def test_archives_are_streamed(monkeypatch):
    """Small reads give the same records, a long archive is never held, and a frame that decodes to too much is refused."""

    class File:
        def __init__(self, data):
            self.data, self.at, self.most = data, 0, 0

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at, self.most = self.at + len(out), max(self.most, n)
            return out

    records = [warc.record(i, "u", b"x%d" % i * 3000, hashlib.sha256(b"x%d" % i * 3000).hexdigest(), None, len(b"x%d" % i * 3000)) for i in range(40)]
    data = b"".join(warc.archive(records, None)) + struct.pack("<II", 0x184D2A50, 3) + b"abc"
    for n in (16, 100, 1 << 20):
        monkeypatch.setattr(warc, "READ_BYTES", n)
        monkeypatch.setattr(warc, "PIECE", min(n, 4096))
        f = File(data)
        got = list(warc.frames(f))
        assert [x for _, x in got] == records and f.most <= max(n, 4096)
        for at, x in got[:5]:
            assert next(warc.frames(data[at:]))[1] == x
    monkeypatch.setattr(warc, "RECORD_BYTES", 1000)
    with pytest.raises(warc.ArchiveError, match="over 1000"):
        list(warc.frames(data))


def test_faults_are_found():
    data, records = sample()
    bad = [data[:-3], data + b"xy", data[:10], b"PK\x03\x04" + data, data + struct.pack("<II", warc.DICTIONARY_MAGIC, 2) + b"ab", data[:20] + b"\0\0\0\0" + data[24:]]
    for x in bad:
        with pytest.raises(warc.ArchiveError):
            list(warc.frames(x))
    r = records[1]
    for x in (r[:-1], r + b"\r\n", r.replace(b"WARC/1.1", b"WARC/9.9"), r.replace(b"WARC-Date", b"X-Date"), r.replace(b"abc1", b"abd1"), r.replace(b"Content-Length: 4", b"Content-Length: 5"), r.replace(b"HTTP/1.1", b"GTTP/1.1"), b"", r.replace(b"WARC-Type: ", b"WARC-Type ")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(x)


def test_licenses(spark, docs, no_docs):
    rng = random.Random(2)
    word = lambda: "w%d" % rng.randrange(500)
    mit = licenses.TEMPLATES["MIT"].split(" ")
    edited = mit[:20] + ["really"] + mit[20:50] + mit[51:]
    texts = [" ".join([word() for _ in range(30)] + x + [word() for _ in range(30)]) for x in (mit, edited, mit[:20], "All rights RESERVED.".split(" "), "Licensed under CC BY-NC 4.0.".split(" "))]
    texts += ["MIT license words without the notice", None, "", " ".join(["all rights reserved"] * 3)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r.id, []).append((r.license, round(r.coverage, 3), r.start, r.stop))
    n = len(words_of(licenses.TEMPLATES["MIT"].encode()))
    assert got[0] == [("MIT", 1.0, 30, 30 + n)]
    assert got[1][0][0] == "MIT" and got[1][0][1] > 0.97
    assert 2 not in got and 5 not in got and 6 not in got and 7 not in got
    assert got[3] == [("All-rights-reserved", 1.0, 30, 33)] and got[4] == [("CC-BY-NC-4.0-notice", 1.0, 30, 37)]
    assert [x[2] for x in sorted(got[8], key=lambda x: x[2])] == [0, 3, 6]
    assert licenses.scan(no_docs).count() == 0 and licenses.scan(docs).count() == 0


def test_band_equals_the_full_alignment():
    rng = random.Random(5)
    for _ in range(60):
        template = [b"%d" % rng.randrange(30) for _ in range(20)]
        noisy = [w if rng.random() > 0.1 else b"z" for w in template if rng.random() > 0.1]
        words = [b"p"] * 15 + noisy + [b"q"] * 15
        assert licenses.align(template, words, 3, 27)[0] == licenses.align(template, words)[0]


def test_index_finds_what_aligning_every_template_finds():
    """Recall of the index against an alignment of each template with each whole text."""
    rng = random.Random(8)
    templates = {n: t for n, t in licenses.TEMPLATES.items() if len(words_of(t.encode())) < 130}
    names, wanted, texts = list(templates), [], []
    for _ in range(120):
        name = rng.choice(names)
        words = [w.decode() for w in words_of(templates[name].encode())]
        if len(words) > 20 and rng.random() < 0.5:  # several words inserted near the middle
            at = len(words) // 2 + rng.randrange(-5, 5)
            words[at:at] = ["x%d" % rng.randrange(99) for _ in range(rng.randrange(1, 12))]
        words = [w if len(words) < 12 or rng.random() > 0.04 else "changed" for w in words]
        texts.append(" ".join(["p%d" % rng.randrange(50) for _ in range(20)] + words + ["q%d" % rng.randrange(50) for _ in range(20)]).encode())
    index = licenses.Index(templates)
    got = {}
    for d, name, m, share, start, stop in index.reports(texts):
        got.setdefault(d, []).append((name, m, start, stop))
    hit = total = 0
    for d, t in enumerate(texts):
        every = [(m, n) for n in names for m, _, _ in [licenses.align(words_of(templates[n].encode()), words_of(t))] if m / len(words_of(templates[n].encode())) >= licenses.COVERAGE]
        if every:
            total += 1
            hit += max(every)[0] in {m for _, m, _, _ in got.get(d, [])}
    assert total > 100 and hit >= 0.98 * total


def test_many_reports_and_templates_from_a_table(spark):
    import time

    index = licenses.Index(licenses.TEMPLATES)
    took = []
    for n in (1000, 4000):
        began = time.time()
        assert len(list(index.reports([b"all rights reserved " * n]))) == n
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 0.5
    rows = spark.createDataFrame([("b", "one two three", 1), ("a", "four five six seven eight nine ten", 2), (None, "x", 3), ("c", None, 4)], "license string, text string, n int")
    templates = licenses.templates_of(rows)
    assert list(templates) == ["a", "b"]
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "four five CHANGED seven eight nine ten")], "doc_id long, text string")
    assert sorted((r.id, r.license, r.matched) for r in licenses.scan(docs, templates).collect()) == [(1, "b", 3), (2, "a", 6)]
