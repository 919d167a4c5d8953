"""Operators whose results are exact, against brute force, over texts with every odd case."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from sparkweld.llm import bpe, decontaminate, fingerprints, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- SimHash


def slow_fingerprint(t):
    w = WORD.findall(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_components(docs, rows, no_docs):
    want_fp = [slow_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (want_fp[i] ^ want_fp[j]).bit_count() <= 2:
            parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min((x for x in (low.get(find(i)), r[0]) if x is not None), default=None)
    want = Counter((r[0], f, low[find(i)]) for i, (r, f) in enumerate(zip(rows, want_fp)))
    got = Counter((r.id, r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_bit_sliced_distance():
    import random

    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(200)]
    fps += [f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ (rng.getrandbits(1) << rng.randrange(64)) for f in fps[:100]]
    planes = simhash.planes_of(fps)
    for radius in (0, 1, 2, 3, 4, 20, 28):
        for p in fps[:60]:
            assert simhash.near_lanes(planes, len(fps), p, radius) == sum(1 << i for i, f in enumerate(fps) if (f ^ p).bit_count() <= radius)


def test_grid_of_chunks_loses_no_link(spark):
    import random

    rng = random.Random(6)
    base = rng.getrandbits(63)
    fps = list({base} | {base ^ 1 << a ^ 1 << b for a, b in itertools.combinations(range(30), 2)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    e = simhash.links(df, chunk=50)
    from sparkweld.llm.components import components

    assert components(e).select("root").distinct().count() == 1 and components(e).count() == len(fps)
    assert e.count() < 12 * len(fps) * 20


# --- decontamination

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_contamination(spark, docs, rows, no_docs, monkeypatch):
    long_text = rows[17][1].split(" ")
    items = [(1, " ".join(long_text[50:75])), (2, "W10 w20"), (3, None), (4, "!!"), (5, " ".join(long_text[60:70]).upper()), (5, "de de de"), (None, " ".join(long_text[5:20])), (6, " ".join(["de"] * 30)), (7, "x")]
    items += [(8, r[1]) for r in rows[20:24] if r[1]]
    bench = spark.createDataFrame([(*i, "e") for i in items], "item_id long, text string, n string")
    windows = defaultdict(set)
    for i, t in items:
        w = ITEM.findall(lower(t))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(i)
    want = Counter()
    for r in rows:
        w, hit, found = ITEM.findall(lower(r[1])), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if x := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    found |= x
        ids = sorted({str(x) for x in found if x is not None})
        want[(r[0], len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit))] += 1
    for most in (decontaminate.MOST_BITS, 1 << 16):  # a sharp bitmap and a dull one
        monkeypatch.setattr(decontaminate, "MOST_BITS", most)
        monkeypatch.setattr(decontaminate, "BITS", 256 if most > 1 << 16 else 1)
        out = decontaminate.verdicts(*decontaminate.contamination(docs, bench))
        got = Counter((r.id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect())
        assert got == want
    assert decontaminate.verdicts(*decontaminate.contamination(no_docs, bench)).count() == 0
    none = decontaminate.verdicts(*decontaminate.contamination(docs, bench.limit(0)))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[5])


# --- substring dedup


def test_substrings(docs, rows, no_docs):
    first = {}
    texts = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for i, w in texts:
        for j in range(len(w) - 12 if i is not None else 0):
            k = tuple(w[j : j + 13])
            first[k] = min(first.get(k, i), i)
    want, removed = Counter(), {}
    for i, w in texts:
        gone = set()
        for j in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[(i, len(w), len(gone), sha(kept))] += 1
        removed[(i, sha(" ".join(w)))] = kept
    got = Counter((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(docs).collect())
    assert got == want and sum(k[2] for k in want) > 100
    out = substrings.cut(docs)
    assert out.schema == docs.schema
    assert Counter((r.doc_id, sha(" ".join(WORD.findall(r.text or "")))) for r in out.collect()) == Counter((k[0], k[3]) for k in want.elements())
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    assert substrings.digest(no_docs).count() == 0


def test_cut_keeps_other_blanks():
    assert substrings.without(b" a  b\tc\nd ", [{"start": 1, "stop": 3}]) == b" a  d "
    assert substrings.without(b"a b c", [{"start": 1, "stop": 3}, {"start": 0, "stop": 2}]) == b""
    assert substrings.without(b"a b", None) == b"a b"


# --- byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers as p

    return bpe.load_ranks(p.path("byte_bpe_50k.tiktoken")), p.PATTERN


def test_bpe_equals_the_library(docs, rows, no_docs, ranks):
    import tiktoken

    table, pattern = ranks
    e = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    want = Counter()
    for r in rows:
        ids = e.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), sha(" ".join(map(str, ids))), sha(r[1] or ""))] += 1
    old, bpe.BLOCK = bpe.BLOCK, 2000
    got = bpe.encode(docs, table, pattern, digest=True).collect()
    bpe.BLOCK = old
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = bpe.decode(bpe.encode(docs, table, pattern, keep=("doc_id", "h")), table).collect()
    assert Counter((r.doc_id, r.decoded.decode()) for r in back) == Counter((r[0], r[1] or "") for r in rows)
    assert all(r.n_tokens == len(r.ids) for r in back)
    assert bpe.encode(no_docs, table, pattern).count() == 0


def test_bpe_special_names_and_other_patterns(spark, ranks):
    import tiktoken

    table, _ = ranks
    pattern = r"\s*\S+|\s+"
    e = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    text = "a <|endoftext|> b  "
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert bpe.encode(df, table, pattern).first().ids == e.encode_ordinary(text)


def test_long_texts_are_split_in_pieces(ranks, monkeypatch):
    import regex

    monkeypatch.setattr(bpe, "PIECE", 20)
    text = " ".join(["It's a lÃ©gÃ¨re   test", "of 12 3x pieces\n\n and  blanks", "don't é stop-it"] * 9).encode()
    s = bpe.Splitter(ranks[1])
    pieces = list(s.pieces(text))
    assert len(pieces) > 10 and [t for p in pieces for t in p] == regex.findall(ranks[1], text.decode())


def test_plain_splitter_equals_the_full_one(ranks):
    import random

    import regex

    s, full = bpe.Splitter(ranks[1]), regex.compile(ranks[1]).findall
    rng = random.Random(3)
    pool = [chr(c) for c in range(0x600)] + list(" '\n\tstmvrel12_²Ⅷ") * 40
    for _ in range(3000):
        t = "".join(rng.choices(pool, k=rng.randrange(14)))
        assert s(t) == full(t), t


# --- fingerprints

BLANK = " \t\n\x0b\x0c\r"
RUN = re.compile(f"(?:[^{BLANK}]*[^{BLANK}.!?][ \t\x0b\x0c\r]+){{0,7}}[^{BLANK}]+")
MASK = (1 << 64) - 1


def hashed(x, seed=42):
    return xxhash.xxh64_intdigest(x, seed % (1 << 64))


def keyed(key, seed):
    """Spark's xxhash64 of a long and an integer."""
    return hashed((seed & 0xFFFFFFFF).to_bytes(4, "little"), hashed(key.to_bytes(8, "little")))


def slow_digests(t):
    return {hashed(x.encode()) for x in RUN.findall(t)} | {hashed((2).to_bytes(4, "little"), hashed(x.encode())) for x in spaced(t)}


def spaced(t):
    """The first sixteen words two by two, with what is between them."""
    m = re.match(f"[{BLANK}]*(?:[^{BLANK}]+[{BLANK}]+){{0,15}}[^{BLANK}]+", t)
    return re.findall(f"[^{BLANK}]+(?:[{BLANK}]+[^{BLANK}]+)?", m[0]) if m else []


def slow_sketch(keys):
    cells, keys = {}, {k >> 32 for k in keys}
    for k in keys:
        check = keyed(k, -1) >> 40
        for s in range(3):
            h = keyed(k, s)
            at = 16 * s + (h - (1 << 64) if h >> 63 else h) % 16
            n, x, c = cells.get(at, (0, 0, 0))
            cells[at] = (n + 1, x ^ k, c ^ check)
    return f"{len(keys)}:" + ":".join(f"{at:x}.{n:x}.{x:x}.{c:x}" for at, (n, x, c) in sorted(cells.items()))


def slow_likeness(a, b):
    """From two fingerprints alone; and the recovered digests, None where some are left."""
    cells, found = {}, set()
    for sign, f in ((1, a), (-1, b)):
        for c in f.split(":")[1:]:
            if c:
                at, n, x, k = (int(v, 16) for v in c.split("."))
                m, y, q = cells.get(at, (0, 0, 0))
                cells[at] = (m + sign * n, y ^ x, q ^ k)
    for step in range(12):
        for at, (n, x, c) in list(cells.items()):
            if at // 16 == step % 3 and abs(n) == 1 and c == keyed(x, -1) >> 40:
                found.add((x, n))
                for s in range(3):
                    h = keyed(x, s)
                    i = 16 * s + (h - (1 << 64) if h >> 63 else h) % 16
                    m, y, q = cells.get(i, (0, 0, 0))
                    cells[i] = (m - n, y ^ x, q ^ c)
    cells = {at: v for at, v in cells.items() if v != (0, 0, 0)}
    differ = len(found)
    if cells:
        net = sum(v[0] for v in cells.values()) / 3
        differ += max(round((sum(v[0] ** 2 for v in cells.values()) - 3 * net * net / 16) / (3 * 15 / 16)), abs(net), 1)
    both = int(a.split(":")[0]) + int(b.split(":")[0])
    differ = min(differ, both)
    return 1.0 if not both else (both - differ) / (both + differ), None if cells else found


def test_fingerprints(docs, rows, no_docs, spark):
    key = lambda r: hashed((r[1] or "").encode(), hashed(r[0].to_bytes(8, "little")) if r[0] is not None else 42)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), key(r) - (1 << 64) if key(r) >> 63 else key(r)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want, exact, near = Counter(), 0, 0
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, n = r[1] or "", nxt[1] or ""
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        sets = [slow_digests(x) for x in (t, e, n)]
        prints = [slow_sketch(x) for x in sets]
        (a, found), (b, _) = slow_likeness(*prints[:2]), slow_likeness(prints[0], prints[2])
        gone, come = (tuple(sorted(map(signed, x))) for x in (sets[0] - sets[1], sets[1] - sets[0]))
        true = [len(sets[0] & x) / len(sets[0] | x) if sets[0] | x else 1.0 for x in sets[1:]]
        if found is not None:
            exact += 1
            assert found == {(x >> 32, 1) for x in sets[0] - sets[1]} | {(x >> 32, -1) for x in sets[1] - sets[0]} and abs(a - true[0]) < 1e-9
        near += abs(a - true[0]) + abs(b - true[1])
        want[(r[0], len(t), sha(e), prints[0], prints[1], round(a, 9), round(b, 9), gone, come)] += 1
    got = fingerprints.fingerprints(docs).collect()
    shown = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), tuple(r.gone), tuple(r.come)) for r in got)
    assert [k[:6] for k in shown - want] == [k[:6] for k in want - shown] and shown == want
    assert 0.6 * len(rows) < exact < len(rows) and near < 0.05 * len(rows)
    assert fingerprints.fingerprints(no_docs).count() == 0
    r = fingerprints.fingerprints(spark.createDataFrame([(4, "abc def ghi")], "doc_id long, text string")).first()
    assert r.edited_sha256 == sha("abc def abc") and 0 < r.near_edited < 1 and r.near_next == 1.0


def test_equal_rows_keep_their_number(spark):
    rows = [(1, "a b c")] * 5 + [(None, "x y")] * 3 + [(2, "d e f")]
    old, fingerprints.REPEATS = fingerprints.REPEATS, 2
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fingerprints.REPEATS = old
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert sorted((r.doc_id or 0, r.edited_sha256 == sha({1: "a b c", None: "x y", 2: "d e f"}[r.doc_id])) for r in got if r.near_next == 1.0) == [(0, False)] * 2 + [(1, False)] * 4
    assert Counter(r.edited_sha256 for r in got if r.doc_id == 1) == Counter([sha("a b a")] * 4 + [sha("a b x")])


def test_larger_sketches_recover_the_differing_digests(spark):
    a, b = set(range(1, 2000)), set(range(1500, 2300))
    rows = [(1, sorted(a), 0, sorted(b), 100.0), (2, [], 0, [7], 1.0), (3, [5], 1, [], 1.0)]
    df = spark.createDataFrame(rows, "row long, own array<long>, kept int, tail array<long>, differ double")
    got, _ = fingerprints.differences(df, 3)
    out = defaultdict(set)
    for r in got.collect():
        out[r.row, r.n].add(r.key)
    assert out[1, 1] == a - b and out[1, -1] == b - a and out[2, -1] == {7} and (3, 1) not in out
    assert got.count() == len(a ^ b) + 1


def test_fingerprints_are_native(docs):
    plan = fingerprints.fingerprints(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
