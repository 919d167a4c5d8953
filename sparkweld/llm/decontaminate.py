"""Benchmark decontamination by winnowing.

Windows are ten consecutive words of a benchmark item. Documents and items keep the least 5-gram hash of every six
neighbouring 5-grams, which is a span of ten words: wherever a window occurs in a document, both keep the same anchor
in it. An anchor stands for the windows that keep it, six at most and neighbours. Documents and benchmark are joined on
their anchors, and each hit is extended over its windows, whose words must be equal; neighbouring windows merge into
shared spans. An item of fewer words than a window is one window of its own length, found by the hash of exactly that
many words.

The benchmark is one row a distinct window with the set of its items, so a phrase of m items and n documents costs m + n
rows. Documents are read once. Before anchors leave a task they are looked up in a bitmap of the benchmark's anchor
hashes, ``BITS`` bits a hash and ``MOST_BITS`` (64 MB) at most: a larger benchmark makes it less sharp and nothing else,
as the join is exact.

Defined cases: null and empty texts have no words and are clean; items without words have no window; items with equal
ids count once, items without an id mark words but are not counted; repeated rows keep their rows; an empty benchmark
finds nothing; extra columns are ignored, and kept by ``clean`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweld.llm.common import drop, fresh, salted_join, save, session, slices, table
from sparkweld.llm.winnow import Words, anchors, grams

WINDOW = 10
K, W = 5, 6
#: Bits of the anchor bitmap: for each hash, at least, and at most; and of a piece that one task makes.
BITS, LEAST_BITS, MOST_BITS, PIECE_BITS = 256, 1 << 16, 1 << 29, 1 << 16
# A-Z become lower case; other ASCII characters that are neither digits nor letters part words; all else is kept
_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_HIT = pa.struct([("h", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("words", pa.binary())])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def in_bitmap(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which of the hashes the bitmap holds, by their leading bits."""
    at = value >> np.uint64(64 - int(len(bits) * 8 - 1).bit_length())
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def windows(x: Words, shorts: list[int], bits: np.ndarray | None = None, whole: bool = False) -> list[tuple[int, int, int, int, bytes]]:
    """``(text, hash, size, position, words)`` of the windows whose hash is in the bitmap (None: of all).

    Size 0 is a window of ten words with its anchor's hash. For each size of ``shorts`` also each run of so many words
    with its own hash; with ``whole`` only those that are a whole text.
    """
    if not len(x.h):
        return []
    pos, value, first, size = anchors(x.h, x.ends, K, W)
    if bits is not None:
        ok = in_bitmap(bits, value)
        value, first, size = value[ok], first[ok], size[ok]
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    found = [(np.repeat(value, size), np.repeat(first, size) + step, 0)]
    for n in shorts:
        value = grams(x.h, n)
        inside = np.arange(n, len(value) + n) <= x.ends[: len(value)]
        if whole:
            at = x.first[x.count == n]
            inside = np.zeros(len(value), bool)
            inside[at] = True
        if bits is not None:
            inside &= in_bitmap(bits, value)
        at = np.flatnonzero(inside)
        found.append((value[at], at, n))
    out = []
    for value, at, n in found:
        text = np.searchsorted(x.first + x.count, at, "right")
        for t, h, p, start in zip(text.tolist(), value.view(np.int64).tolist(), (at - x.first[text]).tolist(), at.tolist()):
            out.append((t, h, n, p, b" ".join(x.words(start, start + (n or WINDOW)))))
    return out


def _items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in slices(batches):
        x = Words(texts, _WORDS)
        found = windows(x, sorted({n for n in x.count.tolist() if 0 < n < WINDOW}), whole=True)
        if found:
            t, h, n, _, w = zip(*found)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(t, pa.int64())), pa.array(h, pa.int64()), pa.array(n, pa.int32()), pa.array(w, pa.binary())], ["id", "h", "size", "words"])


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of ``hashes(h)``: pieces made by the tasks, ``MOST_BITS`` bits at most on the driver."""
    n = hashes.count()
    b = max(LEAST_BITS, min(MOST_BITS, 1 << (BITS * max(1, n) - 1).bit_length())).bit_length() - 1
    at = F.shiftrightunsigned("h", 64 - b)

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for x in batches:
            for piece in np.unique(piece_of := np.array(x.column(0))).tolist():
                bits = pieces.setdefault(piece, np.zeros(PIECE_BITS, bool))
                bits[np.array(x.column(1))[piece_of == piece] % PIECE_BITS] = True
        for piece, bits in pieces.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["piece", "bits"])

    dealt = hashes.select(F.shiftright(at, PIECE_BITS.bit_length() - 1).alias("piece"), at.alias("at")).repartition("piece")
    out = np.zeros(1 << b - 3, np.uint8)
    for r in dealt.mapInArrow(make, "piece long, bits binary").collect():
        out[r.piece * PIECE_BITS // 8 : (r.piece + 1) * PIECE_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, spans, sets)``: ``rows(row, id, n)`` for each document, ``spans(row, start, stop, items)`` for each window
    that it shares, in words, with the number of a set of items, and ``sets(items, ids)`` for these sets."""
    spark = session(docs.sparkSession)
    words = benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("text"))
    every = words.mapInArrow(_items, f"id {benchmark.schema['item_id'].dataType.simpleString()}, h long, size int, words binary")
    ids = F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("ids")
    known = every.groupBy("h", "size", "words").agg(ids).withColumn("items", F.xxhash64("ids"))
    known = save(known, "benchmark")
    sets = known.groupBy("items").agg(F.first("ids").alias("ids"))
    shorts = [r.size for r in known.select("size").where("size > 0").distinct().collect()]  # 1 to 9
    sent = spark.sparkContext.broadcast(bitmap(known.select("h").distinct()))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            x = Words(texts, _WORDS)
            hits: list[list[dict]] = [[] for _ in texts]
            for t, h, n, p, w in windows(x, shorts, sent.value):
                hits[t].append({"h": h, "size": n, "pos": p, "words": w})
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(x.count, pa.int64()), pa.array(hits, pa.list_(_HIT))], ["id", "n", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    scanned = docs.select(F.col(id_col).alias("id"), "text").mapInArrow(scan, f"id {kind}, n long, hits array<struct<h:long,size:int,pos:int,words:binary>>")
    rows = save(scanned.withColumn("row", F.monotonically_increasing_id()), "words")
    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.*")
    met = salted_join(hits, known.select("h", "size", "words", "items"), ["h", "size", "words"], ["row"], 8)
    length = F.when(F.col("size") == 0, WINDOW).otherwise(F.col("size"))
    spans = save(met.select("row", F.col("pos").alias("start"), (F.col("pos") + length).alias("stop"), "items"), "spans")
    return rows.select("row", "id", "n"), spans, sets


def verdicts(rows: DataFrame, spans: DataFrame, sets: DataFrame) -> DataFrame:
    """``(row, id, n_words, n_hit, n_items, items_sha256, contaminated)`` for each document."""
    # words of the union of a document's spans: each adds what reaches beyond all earlier ones
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("stop").over(before), F.lit(0))
    covered = spans.select("row", "start", "stop").distinct().withColumn("add", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", seen)))
    hit = covered.groupBy("row").agg(F.sum("add").alias("n_hit"))
    named = salted_join(spans.select("row", "items").distinct(), sets, ["items"], ["row"], 8)
    named = named.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    out = rows.join(hit, "row", "left").join(named, "row", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("row", "id", F.col("n").alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents without those that hold a window of the benchmark; rows with equal ids or none are told apart by their texts."""
    tag, key, bad_id, bad_tag = (fresh(docs, c) for c in ("_tag", "_key", "_bad", "_bad_tag"))
    tagged = docs.withColumn(tag, F.xxhash64(F.coalesce("text", F.lit(""))))
    keyed = tagged.select(F.struct(F.col(id_col).alias("id"), F.col(tag).alias("tag")).alias(key), "text")
    rows, spans, _ = contamination(keyed, benchmark, key)
    bad = rows.join(spans.select("row").distinct(), "row", "left_semi").select(F.col("id.id").alias(bad_id), F.col("id.tag").alias(bad_tag)).distinct()
    bad = save(bad, "contaminated")
    drop(spans)
    return tagged.join(bad, tagged[id_col].eqNullSafe(F.col(bad_id)) & (F.col(tag) == F.col(bad_tag)), "left_anti").select(*docs.columns)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS k
  FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(s) WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM (SELECT * FROM d, size), unnest(range(1, len(w) - n + 2)) AS t(s)),
met AS (SELECT r, s, n, item_id FROM dw JOIN iw USING (n, k)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, s, n FROM met), unnest(range(s, s + n)) AS t(p) GROUP BY r),
ids AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM met GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""


def query(spark, sf_dir: str) -> DataFrame:
    out = verdicts(*contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
