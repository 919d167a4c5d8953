"""The pipeline: each stage's decisions against brute force or the stage's own operator, on rows with odd cases."""

import hashlib
import re
from collections import Counter

import corpus_pipeline as c
import pytest
from sparkweld.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{i}" for i in range(1, 11)} and set(ORACLES) <= set(QUERIES)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, f in c.STAGES:
        f(spark, seen[-1], SF).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    for x in seen[1:-1]:
        assert x.columns == docs.columns
    ids = [Counter(r.doc_id for r in x.select("doc_id").collect()) for x in seen]
    for a, b in zip(ids, ids[1:]):
        assert not b - a
    assert len(ids[1]) < len(ids[0]) and len(ids[2]) < len(ids[1]) and ids[2] == ids[3] and ids[4] == ids[5]
    # what is left shares no window with a smaller document's input to the stage
    before, after = ({r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text) for r in x.collect()} for x in (seen[2], seen[3]))
    first = {}
    for i in sorted(before):
        for j in range(len(before[i]) - 12):
            first.setdefault(tuple(before[i][j : j + 13]), i)
    for i, w in before.items():
        gone = {j + k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(13)}
        assert after[i] == [x for j, x in enumerate(w) if j not in gone]
    # the last stage decodes to the texts that it got
    texts = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in seen[4].collect()}
    last = seen[-1].collect()
    assert all(r.decoded_sha256 == texts[r.doc_id] and len(r.ids) == r.n_tokens for r in last)
    whole = c.run(spark, SF).select("doc_id", "n_tokens", "ids").collect()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in whole) == Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in last)


@pytest.mark.parametrize("name", [n for n, _ in c.STAGES])
def test_odd_rows(spark, docs, no_docs, name):
    f = dict(c.STAGES)[name]
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    x = f(spark, docs.select(*cols), SF)
    assert x.count() <= docs.count() and (name == "tokens" or x.columns == cols)
    assert f(spark, no_docs.select(*cols), SF).count() == 0
