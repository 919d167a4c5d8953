"""SimHash near-duplicate groups with bit-sliced comparison.

A fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of the text's word shingles have it.
Distinct fingerprints meet where three of five bit blocks are equal: two fingerprints within distance 2 differ in
at most two blocks, so no link is missed. Inside a meeting, fingerprints are stored as bit planes, one wide integer
a bit, and a probe updates the distances to all of them at once with a carry-save counter; it stops when every
distance is over the radius. Each meeting returns a spanning forest of its links and not all pairs, which is what
components need, so a cluster of n fingerprints gives fewer than n rows a meeting.

Defined cases: null and empty texts have fingerprint zero; equal fingerprints are one class, whatever their number;
rows with equal ids each keep a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweld.llm.common import drop, salted_join, save, session, slices, table
from sparkweld.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Bits of the five blocks; any two flipped bits leave three blocks whole.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints of one meeting that are compared in one go; a larger meeting becomes a grid of such chunks.
CHUNK = 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def text_fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one UTF-8 text, as an unsigned number."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits, step = np.zeros(64, np.int64), 1 << 15
    for i in range(0, len(a), step):  # long texts in pieces: 64 bytes a shingle
        part = np.array([digest(joined[x:y], seed) for x, y in zip(a[i : i + step], b[i : i + step])], dtype="<u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(a), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(id, fp)``: one row a document, the fingerprint as a signed long."""
    session(docs.sparkSession)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            fps = np.array([text_fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, fp long")


def planes_of(fps: list[int], size: int = 64) -> list[int]:
    """Bit planes: the i-th number holds bit i of every fingerprint, one fingerprint a lane."""
    rows = np.frombuffer(b"".join(f.to_bytes(size // 8, "little") for f in fps), np.uint8).reshape(-1, size // 8)
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [int.from_bytes(np.packbits(bits[:, i], bitorder="little").tobytes(), "little") for i in range(size)]


def near_lanes(planes: list[int], lanes: int, probe: int, radius: int = RADIUS) -> int:
    """Lanes within ``radius`` of ``probe``, as a bit mask.

    A carry-save counter adds the differing bits of all lanes at once, a plane a step; it begins so high that a lane's
    last digit overflows when its distance passes the radius. Once all lanes have, the block is abandoned.
    """
    full, width = (1 << lanes) - 1, radius.bit_length()
    start = (1 << width) - 1 - radius
    digits, over = [full if start >> k & 1 else 0 for k in range(width)], 0
    for i, plane in enumerate(planes):
        carry = plane ^ full if probe >> i & 1 else plane
        for k in range(width):
            digits[k], carry = digits[k] ^ carry, digits[k] & carry
            if not carry:
                break
        else:
            over |= carry
            if over == full:
                return 0
    return full & ~over


def forest(left: list[int], right: list[int] | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links among ``left`` (``right`` None) or between both sides, reduced to a spanning forest."""
    lanes = left if right is None else right
    planes, parent = planes_of(lanes), {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = []
    for i, probe in enumerate(left):
        mask = near_lanes(planes, len(lanes), probe, radius)
        if right is None:
            mask >>= i + 1
        base = 0 if right is not None else i + 1
        while mask:
            low = (mask & -mask).bit_length() - 1
            mask &= mask - 1
            a, b = find(probe), find(lanes[base + low])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((probe, lanes[base + low]))
    return out


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by meeting; a meeting's rows are its one chunk (side 0) or the two chunks of a grid cell."""

    def done(sides: tuple[list[int], list[int]]) -> pa.RecordBatch | None:
        a, b = sides
        pairs = forest(a, None) if not b else forest(a, b) if a else []
        if not pairs:
            return None
        both = np.array(pairs, dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["u", "v"])

    last, sides = None, ([], [])
    for batch in batches:
        for block, key, cell, fp, side in zip(*(c.to_pylist() for c in batch.columns)):
            if (block, key, cell) != last:
                if last is not None and (out := done(sides)) is not None:
                    yield out
                last, sides = (block, key, cell), ([], [])
            sides[side].append(fp & 0xFFFFFFFFFFFFFFFF)
    if last is not None and (out := done(sides)) is not None:
        yield out


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``fps(fp)`` distinct fingerprints; returns ``(u, v)``, links within distance 2 that connect all that is connected."""
    if radius != RADIUS:
        raise ValueError("the blocks are laid out for radius 2")
    shifts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << n) - 1)) for s, n in zip(shifts, BLOCKS)]
    keys = [
        F.struct(F.lit(i).alias("block"), block[a].bitwiseOR(F.shiftleft(block[b], 13)).bitwiseOR(F.shiftleft(block[c], 26)).alias("key"))
        for i, (a, b, c) in enumerate(combinations(range(5), 3))
    ]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.block", "k.key")
    met = rows.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = salted_join(rows, met, ["block", "key"], ["fp"], 8)
    # a meeting of over `chunk` fingerprints is a grid of chunk pairs; cell (i, j) holds chunk i (side 0) and chunk j (side 1)
    rows = rows.withColumn("c", F.ceil(F.col("n") / chunk).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other")
    rows = rows.select("block", "key", "fp", "own", "c", other)
    rows = rows.select(
        "block", "key", (F.least("own", "other") * F.col("c") + F.greatest("own", "other")).alias("cell"), "fp", (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    rows = rows.repartition("block", "key", "cell").sortWithinPartitions("block", "key", "cell")

    return rows.mapInArrow(_compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)``: the component is the smallest id that links reach, the document's own included.

    Null ids have a fingerprint and a component as others do; a component without any id has a null one.
    """
    rows = save(fingerprints(docs, id_col, text_col).withColumn("seat", F.monotonically_increasing_id()), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("low"))
    roots = components(links(nodes.select("fp")))
    lows = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = save(lows, "simhash-lows")
    drop(roots)
    least = lows.groupBy("root").agg(F.min("low").alias("component"))
    by_fp = salted_join(lows.select("fp", "root"), least, ["root"], ["fp"]).select("fp", "component")
    return salted_join(rows, by_fp, ["fp"], ["seat"]).select("id", "fp", "component")


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
