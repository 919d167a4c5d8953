"""Near-duplicate groups of the pipeline against brute force."""

import random

from sparkweld.llm import near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grouped(texts):
    """Component (smallest id) of each text by brute force over all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def edited(rng, text, k):
    w = text.split()
    for i in rng.sample(range(len(w)), k):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    line, texts = text(12), []
    for n in (8, 20, 60, 200, 400):
        for _ in range(6):
            base = text(n)
            texts += [base, base.upper(), *(edited(rng, base, max(1, n * k // 400)) for k in (1, 4, 8, 12, 20))]
    texts += [f"{line} {text(rng.randrange(1, 60))}" for _ in range(60)]
    hot = text(80)
    texts += [edited(rng, hot, rng.randrange(1, 3)) for _ in range(60)] + ["", None, " \n", "one", "one", "two words"]
    rng.shuffle(texts)
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def test_groups_are_those_of_brute_force(spark):
    texts = corpus()
    got = {r.id: r.component for r in near.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == grouped(texts)


def test_small_chunks_and_buckets_lose_no_link(spark):
    texts = corpus()
    docs = frame(spark, texts)
    sizes = near.classes(docs, "doc_id", "text").groupBy("fp").agg({"m": "max", "sim": "max"}).toDF("fp", "sim", "m")
    e = {tuple(r) for r in near.links(docs, sizes, "text", chunk=7, bucket=500).collect()}
    names = [near._name(x) for x in near.shingle_sets([(t or "").encode() for t in texts])]
    fps = [x - (1 << 64) if x >> 63 else x for x in names]
    root = {f: f for f in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in e:
        root[find(a)] = find(b)
    want, mine = grouped(texts), [find(f) for f in fps]
    assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))


def test_the_radius_holds_all_near_pairs():
    """Of sets that are alike to 0.8 the bits that differ stay far below the radius; those of unlike sets pass it."""
    import numpy as np

    rng = np.random.default_rng(5)
    far, unlike, n = 0, 0, 4000
    for _ in range(n):
        m = int(rng.integers(4, 40))
        h = rng.integers(0, 1 << 63, 2 * m, dtype=np.uint64)
        cut = m // 9  # of both sides: 8 in 10 are shared
        a, b = (h[:m], h[: m - m // 5]) if rng.random() < 0.5 else (h[cut : m + cut], h[: m + cut][: m])
        f = [int.from_bytes(near.fingerprint(np.unique(x)), "little") for x in (a, b, h[m:])]
        assert 5 * len(set(a.tolist()) & set(b.tolist())) >= 4 * len(set(a.tolist()) | set(b.tolist()))
        far = max(far, (f[0] ^ f[1]).bit_count())
        unlike += (f[1] ^ f[2]).bit_count() > near.RADIUS if cut == 0 else 1
    assert far <= near.RADIUS - 6 and unlike > 0.95 * n


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(9)
    base = [" ".join(f"v{rng.randrange(10**5)}" for _ in range(100)) for _ in range(20)]
    docs = frame(spark, base + [edited(rng, t, 2) for t in base])
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").select("doc_id").collect()
    assert {r.doc_id for r in kept} == set(range(20))
