"""Substring dedup: seed on winnowed anchors, extend both ways, cut what a smaller document already has.

A window is 13 consecutive words; a word goes if a window over it also starts in a document with a smaller id.

* Seed: each document keeps the least 5-gram hash of every nine neighbouring 5-grams, a span of 13 words, so equal
  windows keep the same anchor. Anchor hashes of two or more documents are found by an aggregation with map-side combine.
* Extend: an anchor reaches left and right over all windows that keep it; its context is the hash of those words.
  Occurrences with equal contexts share all their windows at once, so all but the smallest document are settled without
  comparing them one by one, and one occurrence of a context stands for all. Only where an anchor has several contexts
  are these extended window by window: one row a window of each context, again aggregated to its smallest document.
* Keep maximal: settled windows of a document merge into maximal repeats, which are cut.

Nothing is compared pair by pair, so a group of n copies costs n rows. Context and window keys have 128 bits with the
anchor's hash. The text is read twice for anchors and shuffled twice by document, never by anchor. Anchors, contexts and
windows that very many documents have are counted first and dealt over several tasks (``spread_join``).

Defined cases: null and empty texts have no words; texts of fewer than 13 words lose none; rows with equal ids do not
count against each other and each keep a row; rows without an id lose and take nothing; extra columns stay in ``cut``,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweld.llm.common import drop, fresh, save, session, slices, spread_join, table
from sparkweld.llm.winnow import Words, anchors, grams, mix, stretches

WINDOW = 13
K, W = 5, 9
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_TAG = 0x7FFFFFFF


def seeds(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Anchors: document number, hash, context hash, first window, number of windows."""
    x = Words(texts)
    pos, value, first, size = anchors(x.h, x.ends, K, W)
    shape = ((pos - first) * 16 + size).astype(np.uint64)
    c = mix(stretches(x.h, first, first + size - 1 + WINDOW) + shape * np.uint64(0xD6E8FEB86659FD93))
    doc = np.searchsorted(x.first + x.count, pos, "right")
    return {"doc": doc, "h": value.view(np.int64), "c": c.view(np.int64), "first": first - x.first[doc], "size": size}


def _tag(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 42) & _TAG


def tag_column(text: str):
    """The same for a column: tells rows with equal ids apart by their texts."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(_TAG))


def _scan(full: bool):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            ids = np.array(rows.column(0))
            x = seeds(texts)
            cols = [pa.array(x["h"]), pa.array(ids[x["doc"]], pa.int64())]
            if full:
                tags = np.fromiter(map(_tag, texts), np.int64, len(texts))
                cols += [pa.array(x["c"]), pa.array((tags[x["doc"]] << 32) | x["first"]), pa.array(x["size"].astype(np.int8))]
            yield pa.RecordBatch.from_arrays(cols, ["h", "doc", "c", "at", "size"][: len(cols)])

    return scan


def _unroll(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their representative anchors: a row for each window of each."""
    for rows, texts in slices(batches):
        ids, reps = np.array(rows.column(0).to_pylist(), np.int64), rows.column(2)
        x = Words(texts)
        g = grams(x.h, WINDOW).view(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(np.array(reps.offsets)))
        rep = reps.flatten()
        first, size, c, key = (np.array(rep.field(n), np.int64) for n in ("first", "size", "c", "h"))
        j = np.repeat(np.arange(len(first)), size)
        step = np.arange(len(j)) - np.repeat(np.cumsum(size) - size, size)
        tags = np.fromiter(map(_tag, texts), np.int64, len(texts))
        at = first[j] + (tags[doc[j]] << 32)
        out = (key[j], g[x.first[doc[j]] + first[j] + step], c[j], ids[doc[j]], at, step)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["h", "w", "c", "doc", "at", "step"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, tag, spans)``: spans, in words, that windows of smaller documents cover; a row a document that has some."""
    spark = session(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col("doc").isNotNull())
    shared = texts.mapInArrow(_scan(False), "h long, doc long").groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"))
    shared = save(shared.where("low < high").select("h", "n"), "anchors")
    seen = texts.mapInArrow(_scan(True), "h long, doc long, c long, at long, size tinyint")
    seen = save(spread_join(seen, shared, ["h"], ["doc", "at"]), "occurrences")
    drop(shared)
    alike = seen.groupBy("h", "c").agg(F.min(F.struct("doc", "at", "size")).alias("first"), F.count("*").alias("n"))
    alike = save(alike.select("h", "c", "first", "n"), "contexts")
    # occurrences after the first document of their context: every window of theirs is known from there; and those in
    # the first document itself, but at another place, which keep the names of their anchor and context
    both = spread_join(seen, alike.select("h", "c", F.col("first.doc").alias("low"), F.col("first.at").alias("first_at"), "n"), ["h", "c"], ["doc", "at"])
    named = lambda c: F.when(F.col("doc") == F.col("low"), F.col(c)).alias(c)
    others = save(both.where("doc > low or at <> first_at").select("doc", "at", "size", named("h"), named("c")), "others")
    drop(seen)
    # anchors with several contexts: one occurrence of each, window by window
    several = save(alike.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "branching")
    parts = F.struct(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("first"), F.col("size").cast("long").alias("size"), "c", "h")
    reps = spread_join(alike.drop("n"), several, ["h"], ["c"]).select("first.*", "h", "c").groupBy("doc", F.shiftright("at", 32).alias("tag")).agg(F.collect_list(parts).alias("reps"))
    reps = save(reps, "representatives")
    drop(alike, several)
    # of repeated rows one is enough, and one is all that the shuffle gets
    mine = texts.withColumn("tag", tag_column("text"))
    often = save(mine.groupBy("doc", "tag").agg(F.count("*").alias("n")).where("n > 1"), "repeated-rows")
    again = not often.isEmpty()
    if again:
        twice = mine.join(often.drop("n"), ["doc", "tag"], "left_semi").groupBy("doc", "tag").agg(F.first("text").alias("text"))
        mine = mine.join(often.drop("n"), ["doc", "tag"], "left_anti").unionByName(twice.select("doc", "text", "tag"))
    rows = mine.join(reps, ["doc", "tag"]).select("doc", "text", "reps")
    windows = save(rows.mapInArrow(_unroll, "h long, w long, c long, doc long, at long, step long"), "windows")
    drop(reps, often)
    lows = windows.groupBy("h", "w").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"))
    lows = save(lows.where("low < high").select("h", "w", "low", "n"), "window-lows")
    known = spread_join(windows, lows, ["h", "w"], ["doc", "at"]).where("low < doc").select("h", "c", "doc", "at", F.col("step").cast("int").alias("step")).distinct()
    known = save(known, "known-windows")
    drop(windows, lows)
    later = others.where("h is null").select("doc", "at", F.lit(0).alias("step"), F.col("size").cast("int").alias("n"))
    edge = known.select("doc", "at", "step", F.lit(1).alias("n"))
    named = others.where("h is not null").select("h", "c", "doc", "at")
    steps = known.select("h", "c", "step").distinct().join(named.groupBy("h", "c").agg(F.count("*").alias("n")), ["h", "c"])
    steps = save(steps, "steps")
    more = spread_join(named, steps, ["h", "c"], ["doc", "at"]).select("doc", "at", "step", F.lit(1).alias("n"))
    every = later.unionByName(edge).unionByName(more)
    start = (F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)) + F.col("step")).cast("int")
    every = every.select("doc", F.shiftright("at", 32).alias("tag"), F.struct(start.alias("start"), (start + F.col("n") - 1 + WINDOW).alias("stop")).alias("span"))
    out = save(every.groupBy("doc", "tag").agg(F.collect_set("span").alias("spans")), "repeats")
    drop(others, known, steps)
    return out


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, id_col: str, text_col: str, spans: str) -> DataFrame:
    """``docs`` with a column ``spans`` of that name."""
    at, doc, tag = (fresh(docs, c) for c in ("_at", "_doc", "_tag"))
    found = repeats(docs, id_col, text_col).select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("spans").alias(spans))
    tagged = docs.withColumn(at, tag_column(text_col))
    return tagged.join(found, (F.col(id_col).cast("long") == F.col(doc)) & (F.col(at) == F.col(tag)), "left").drop(doc, tag, at)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256)`` for each document."""

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            spans, out = rows.column(2).to_pylist(), []
            for t, s in zip(texts, spans):
                words = t.split()
                n, kept, at = len(words), [], 0
                for a, b in _merged(s):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            a, b, c = zip(*out)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], ["id", "n_words", "n_removed", "kept_sha256"])

    x = _with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    return x.mapInArrow(apply, f"id {kind}, n_words long, n_removed long, kept_sha256 string")


def without(text: bytes, spans: list[dict] | None) -> bytes:
    """The text less the words of the spans and the blanks after each of them; other blanks stay as they are."""
    cut = _merged(spans)
    if not cut:
        return text
    starts = [m.start() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in cut:
        out.append(text[at : starts[a]])
        at = starts[b] if b < len(starts) else len(text)
    return b"".join([*out, text[at:]])


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """Documents with their repeats cut out of the text, all columns kept; ``size_col``, if there, gets the new length."""
    extra = fresh(docs, "_spans")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, text_col):
            names = rows.schema.names
            spans = rows.column(names.index(extra)).to_pylist()
            new = pa.array([without(t, s) for t, s in zip(texts, spans)], pa.binary()).cast(pa.string())
            old = rows.column(names.index(text_col))
            new = pa.compute.if_else(pa.compute.is_null(old), pa.scalar(None, pa.string()), new)
            keep = [i for i, n in enumerate(names) if n != extra]
            yield pa.RecordBatch.from_arrays([new if names[i] == text_col else rows.column(i) for i in keep], [names[i] for i in keep])

    out = _with_spans(docs, id_col, text_col, extra).mapInArrow(apply, docs.schema)
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))
    return out


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, s, array_to_string(w[s : s + 12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) AS t(s)),
low AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, s FROM win JOIN low USING (k) WHERE low < doc_id), unnest(range(s, s + 13)) AS t(p)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
