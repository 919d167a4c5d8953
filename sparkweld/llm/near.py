"""SimHash near-dedup at a Jaccard index: texts whose sets of five-word shingles are alike to 0.8 or more.

At this likeness about a seventh of a fingerprint's bits differ, so no layout of equal bit blocks finds all links, as the
one of ``simhash`` does for two bits. Candidates meet by their rarest shingles instead, which loses none: two such sets
share one of them at least, of a set of m one of the first ``m - ceil(0.8 m) + 1`` in the order of (number of texts that
have the shingle, hash). Shingles are dealt into buckets by their hash and counted there; those that one text alone has
can't be shared and end there, but they fill a text's first places. Texts that share a first place are one block (star
edges, so a shingle of n texts gives n rows), a large one a grid of chunks.

Inside a cell the texts' 128-bit fingerprints are stored as bit planes and a probe's distances to all of them are counted
at once by carry-save (``simhash.near_lanes``); it is abandoned where all pass ``RADIUS``. What is left, less what is
connected already, is compared by the sets themselves. Bits of sets that are alike to 0.8 differ with a probability
of 0.19 at most, so that the radius loses a link with one below 1e-9; no other step loses any. Each cell returns a spanning
forest of its links.

Defined cases: letters are lowered in ASCII and words split at white space; a text of fewer than five words is one
shingle; null texts and texts without words are one class and similar to nothing else; rows with equal sets are one class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweld.llm.common import drop, fresh, salted_join, save, session, slices
from sparkweld.llm.components import components
from sparkweld.llm.simhash import _LOWER, near_lanes, planes_of
from sparkweld.llm.winnow import Words, grams, mix

SHINGLE = 5
#: The least Jaccard index, as a fraction: integers decide.
NEAR = (4, 5)
#: Bits of a fingerprint and those that may differ.
BITS, RADIUS = 128, 52
#: Shingles of one bucket, about, and texts of one chunk of a block.
BUCKET = 1 << 20
CHUNK = 512


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingle hashes of each UTF-8 text, sorted."""
    x = Words(texts, _LOWER)
    g = grams(x.h, shingle)
    return [
        np.unique(g[a : a + n - shingle + 1] if n >= shingle else grams(x.h[a : a + n], n) if n else g[:0])
        for a, n in zip(x.first.tolist(), x.count.tolist())
    ]


def fingerprint(s: np.ndarray) -> bytes:
    """SimHash of a set: bits that over half of its hashes have."""
    count, step = np.zeros(BITS, np.int64), 1 << 14
    for i in range(0, len(s), step):
        h = s[i : i + step]
        both = np.stack((h, mix(h ^ np.uint64(0x5851F42D4C957F2D))), axis=1)
        count += np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(count * 2 > len(s), bitorder="little").tobytes()


def _name(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, tag, fp, m, sim)``: one row a document; ``fp`` names its shingle set, ``m`` is the set's size, ``sim`` its
    fingerprint, ``tag`` a hash of the text."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            sets = shingle_sets(texts)
            fps = np.array([_name(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary())], ["id", "tag", "fp", "m", "sim"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_tag(text_col).alias("tag"), F.col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, tag long, fp long, m long, sim binary")


def text_tag(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _deal(buckets: int):
    """A slice's shingles by bucket: of each text with some in it the name and their number, and the hashes."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            sets = {_name(s): s for s in shingle_sets(texts) if len(s)}
            if not sets:
                continue
            h = np.concatenate(list(sets.values()))
            doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets.values()])
            at = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            h, doc, at, names = h[order], doc[order], at[order], np.fromiter(sets, np.uint64, len(sets))
            cuts = np.flatnonzero(np.diff(at)) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                d, n = np.unique(doc[a:b], return_counts=True)
                out.append((int(at[a]), names[d].tobytes(), n.astype("<u4").tobytes(), h[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "names", "n", "h"])

    return scan


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket; ``(fp, h, freq)`` of shingles that two sets or more have."""

    def done(parts: list) -> Iterator[pa.RecordBatch]:
        f = np.concatenate([np.repeat(np.frombuffer(a, np.uint64), np.frombuffer(n, "<u4")) for a, n, _ in parts])
        h = np.concatenate([np.frombuffer(x, np.uint64) for _, _, x in parts])
        order = np.lexsort((f, h))
        f, h = f[order], h[order]
        once = np.concatenate(([True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])))
        f, h = f[once], h[once]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        n = np.diff(np.concatenate((first, [len(h)])))
        freq = np.repeat(n, n)
        keep = freq > 1
        f, h, freq = f[keep].view(np.int64), h[keep].view(np.int64), freq[keep]
        for i in range(0, len(f), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (f, h, freq)], ["fp", "h", "freq"])

    last, parts = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != last and parts:
                yield from done(parts)
                parts = []
            last = bucket
            parts.append(row)
    if parts:
        yield from done(parts)


Lane = tuple[int, int, np.ndarray, int]


def forest(left: list[Lane], right: list[Lane] | None, near: tuple[int, int] = NEAR, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links among ``left`` (``right`` None) or between both sides, reduced to a spanning forest.

    A row is the set's name, its size, those of its hashes that other sets have too, as only these can be common, and
    its fingerprint.
    """
    lanes = left if right is None else right
    names, sizes = [x[0] for x in lanes], np.array([x[1] for x in lanes], np.int64)
    h = np.concatenate([x[2] for x in lanes])
    owner = np.repeat(np.arange(len(lanes)), [len(x[2]) for x in lanes])
    order = np.argsort(h, kind="stable")
    h, owner, planes, out = h[order], owner[order], planes_of([x[3] for x in lanes], BITS), []
    # the component of each lane, and of each probe
    at = np.arange(len(lanes))
    mine = at if right is None else np.arange(len(left)) + len(lanes)
    for i, (name, m, s, probe) in enumerate(left):
        mask = near_lanes(planes, len(lanes), probe, radius)
        if not mask:
            continue
        maybe = np.unpackbits(np.frombuffer(mask.to_bytes((len(lanes) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(lanes)] > 0
        if right is None:
            maybe[: i + 1] = False
        maybe &= at != mine[i]
        if not maybe.any():
            continue
        a, b = np.searchsorted(h, s, "left"), np.searchsorted(h, s, "right")
        n = b - a
        seats = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else a
        both = np.bincount(owner[seats], minlength=len(lanes))
        for j in np.flatnonzero(maybe & (both * near[1] >= near[0] * (m + sizes - both))).tolist():
            u, v = mine[i], at[j]
            if u != v:
                out.append((name, names[j]))
                at[at == v] = u
                mine[mine == v] = u
    return out


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and cell; a cell has the rows of its one chunk (side 0) or of two."""

    def done(a: list, b: list) -> Iterator[pa.RecordBatch]:
        pairs = forest(a, None) if not b else forest(a, b) if a else []
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    last, sides = None, ([], [])
    for batch in batches:
        root, cell, side, fp, m, sim = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6))
        sets = batch.column(5)
        ends, values = np.array(sets.offsets), np.array(sets.values)
        for i in range(len(root)):
            if (root[i], cell[i]) != last:
                if last is not None:
                    yield from done(*sides)
                last, sides = (root[i], cell[i]), ([], [])
            sides[side[i]].append((fp[i], m[i], values[ends[i] : ends[i + 1]].copy(), int.from_bytes(sim[i], "little")))
    if last is not None:
        yield from done(*sides)


def links(docs: DataFrame, sizes: DataFrame, text_col: str, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """``(u, v)``: names of sets, links of at least the similarity that connect all that is connected. ``sizes(fp, m, sim)``: distinct sets."""
    spark = docs.sparkSession
    buckets = 1 + (sizes.agg(F.sum("m")).first()[0] or 0) // bucket
    dealt = docs.select(F.col(text_col).alias("text")).mapInArrow(_deal(buckets), "bucket int, names binary, n binary, h binary")
    shared = save(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "fp long, h long, freq long"), "near-shared")
    # the first places of each set; shingles that one set alone has come before all others
    all_of, w = Window.partitionBy("fp"), Window.partitionBy("fp").orderBy("freq", "h")
    places = F.col("m") - F.floor((NEAR[0] * F.col("m") + NEAR[1] - 1) / NEAR[1]) + 1
    first = shared.join(sizes.select("fp", "m"), "fp").withColumn("at", F.row_number().over(w)).withColumn("c", F.count("*").over(all_of))
    first = save(first.where(F.col("at") <= places - (F.col("m") - F.col("c"))).select("fp", "h"), "near-first")
    met = first.groupBy("h").agg(F.count("*").alias("n"), F.min("fp").alias("low")).where("n > 1")
    blocks = components(salted_join(first, met, ["h"], ["fp"]).select(F.col("fp").alias("u"), F.col("low").alias("v")))
    # a block of over `chunk` sets is a grid of chunk pairs; cell (i, j) holds chunk i (side 0) and chunk j (side 1)
    n = blocks.groupBy("root").agg(F.count("*").alias("n"))
    x = salted_join(blocks, n, ["root"], ["node"]).select("root", F.col("node").alias("fp"), F.ceil(F.col("n") / chunk).cast("int").alias("c"))
    x = x.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    sets = shared.join(blocks.select(F.col("node").alias("fp")), "fp").groupBy("fp").agg(F.collect_list("h").alias("s")).join(sizes, "fp")
    x = x.join(sets, "fp").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    cell = F.least("own", "other") * F.col("c") + F.greatest("own", "other")
    x = x.select("root", cell.alias("cell"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp", "m", "s", "sim")
    x = x.repartition("root", "cell").sortWithinPartitions("root", "cell")
    out = save(x.mapInArrow(_compare, "u long, v long").distinct(), "near-links")
    drop(shared, first, blocks)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, tag, fp, component)``: the component is the smallest id that links reach, the document's own included; null without any id."""
    session(docs.sparkSession)
    rows = save(classes(docs, id_col, text_col).withColumn("seat", F.monotonically_increasing_id()), "near")
    nodes = save(rows.groupBy("fp").agg(F.min("id").alias("low"), F.max("m").alias("m"), F.max("sim").alias("sim")), "near-classes")
    found = links(docs, nodes.select("fp", "m", "sim"), text_col)
    roots = components(found)
    lows = save(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "near-lows")
    drop(found, nodes, roots)
    least = lows.groupBy("root").agg(F.min("low").alias("component"))
    by_fp = salted_join(lows.select("fp", "root"), least, ["root"], ["fp"]).select("fp", "component")
    return salted_join(rows.select("id", "tag", "fp", "seat"), by_fp, ["fp"], ["seat"]).drop("seat")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without those that have a near copy with a smaller id. Rows are told apart by id and text: of other texts
    under an id each is decided for itself, of rows with equal id and text the least one stays, rows without an id stay."""
    tag, gone_id, gone_tag, row = (fresh(docs, c) for c in ("_tag", "_id", "_t", "_row"))
    near = save(near_duplicates(docs, id_col, text_col).select("id", "tag", "component"), "near-verdicts")
    key = [F.col("id").alias(gone_id), F.col("tag").alias(gone_tag)]
    gone = near.where("component < id").select(*key).distinct()
    again = save(near.where("id is not null").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "near-again")
    tagged = docs.withColumn(tag, text_tag(text_col))
    same = lambda x: (tagged[id_col] == x[gone_id]) & (tagged[tag] == x[gone_tag])
    kept = tagged.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    # an aggregation with map-side combine, so that very many repeats of one row don't meet in one task
    whole = F.struct(*docs.columns)
    least = F.struct(*(f.name for f in docs.schema.fields if not {"map", "variant"} & set(f.dataType.simpleString().replace("<", ",").replace(":", ",").split(","))))
    one = kept.join(again, same(again), "left_semi").groupBy(id_col, tag).agg(F.min_by(whole, least).alias(row)).select(f"{row}.*")
    return kept.join(again, same(again), "left_anti").select(*docs.columns).unionByName(one)
