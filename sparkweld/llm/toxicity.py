"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Training texts of each class give a dictionary: the stretches whose byte n-grams are over-represented in that class,
beside the same common text in both, so that a window which holds neither compresses alike with both. The content is
picked that way and not by zstandard's own trainer: what parts the classes is a few words a text, which the trainer,
going by frequency alone, leaves out (the README has the figures). A text is cut into short windows at blanks; a window's
gain is its compressed length with the ordinary dictionary less that with the toxic one. Counts of windows whose gain
passes each threshold, and the greatest gain, go through a logistic calibration fitted on other training rows.

The fit takes a bounded sample of labelled rows: about ``SAMPLE`` of each class at most, those with the lowest hash of the
id, one row an id, and none whose text has over ``LONGEST`` bytes. Scores take whole texts of any length.

Defined cases: null and empty texts have no window and get the calibration's score for that; without labelled rows of
both classes every score is the share of label 1 (0 without any label); repeated rows keep their rows; rows without an
id are never held out; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweld.llm.common import drop, fold, hashed_sample, save, session, slices, table
from sparkweld.llm.quality import logistic
from sparkweld.llm.winnow import grams, word_hashes

#: Labelled rows of each class that the fit takes, about at most.
SAMPLE = 3000
#: Bytes of a text in the sample, at most: 192 MB of texts reach the driver in the worst case.
LONGEST = 32 << 10
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Bytes of a window at least (it ends at the next blank), and of each half of a dictionary.
WINDOW, CONTENT = 32, 8 << 10
GRAM, BUCKETS, EXCESS = 7, 1 << 20, 5.0
GAINS = (2, 3, 4, 5, 6, 8)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The text, lower-cased and with single blanks, cut at the first blank after each ``size`` bytes (hard after twice that)."""
    t = b" ".join(text.translate(_LOWER).split())
    out, at = [], 0
    while at < len(t):
        cut = t.find(b" ", at + size, at + 2 * size)
        cut = (cut + 1) if cut >= 0 else min(len(t), at + 2 * size)
        out.append(t[at:cut])
        at = cut
    return out


def _grams(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(a) < GRAM:
        return np.zeros(0, np.int64)
    h = np.zeros(len(a) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(0x100000001B3) + a[j : len(a) - GRAM + 1 + j]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _shares(texts: list[bytes]) -> np.ndarray:
    """Of each n-gram bucket, the number of texts that have it."""
    df = np.zeros(BUCKETS)
    for t in texts:
        df[np.unique(_grams(t))] += 1
    return df


def _excess(own: np.ndarray, n: int, other: np.ndarray, m: int) -> np.ndarray:
    """Of each bucket, by how many standard errors its share among ``n`` texts is over that among ``m`` others."""
    both = (own + other + 1) / (n + m + 2)
    return (own / n - other / m) / np.sqrt(both * (1 - both) * (1 / n + 1 / m))


def _marked(texts: list[bytes], excess: np.ndarray) -> list[bytes]:
    """Stretches of the texts whose n-grams are all over-represented (by ``EXCESS`` standard errors).

    Best first, by the excess of n-grams that no better stretch holds; those that add nothing are left out.
    """
    seen: Counter[bytes] = Counter()
    for t in texts:
        g = _grams(t)
        on = np.concatenate(([False], excess[g] > EXCESS, [False]))
        edge = np.flatnonzero(on[1:] != on[:-1])
        seen.update({t[a : b + GRAM - 1] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())})
    left, out = np.where(excess > EXCESS, excess, 0), []
    worth = lambda w: float(left[np.unique(_grams(w))].sum()) / (len(w) + 4)
    heap = [(-worth(w), w) for w, n in seen.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        was, w = heapq.heappop(heap)
        if (now := worth(w)) < -was - 1e-9:
            if now > 0:
                heapq.heappush(heap, (-now, w))
            continue
        out.append(w)
        left[_grams(w)] = 0
    return out


def _content(ranked: list[bytes], size: int) -> bytes:
    """The first windows that fit, without repeats, the best ones last: near offsets are the cheapest."""
    picked, total = [], 0
    for w in dict.fromkeys(ranked):
        if total + len(w) > size:
            break
        picked.append(w)
        total += len(w)
    return b" ".join(reversed(picked))


@dataclass
class Scorer:
    """Dictionaries and calibration, as plain data that travels to the executors."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray | None
    constant: float = 0.0

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("toxic", "ordinary", "weights", "constant")} | {"_pair": None}

    def compressors(self) -> tuple:
        if self._pair is None:
            params = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_GREEDY, min_match=5, window_log=15, chain_log=14, hash_log=14, search_log=3, target_length=8,
                write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            pair = []
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
            self._pair = tuple(pair)
        return self._pair

    def gains(self, text: bytes) -> np.ndarray:
        ordinary, toxic = self.compressors()
        cut = windows(text)
        return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in cut), np.int64, len(cut))

    def features(self, text: bytes) -> np.ndarray:
        g = self.gains(text)
        n = len(g)
        return np.array([*(np.log1p((g >= k).sum()) for k in GAINS), *(np.sqrt((g >= k).sum() / max(1, n)) for k in GAINS), np.clip(g.max(initial=0), 0, 12), np.log1p(n)])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))


def unlike(texts: list[bytes]) -> list[bytes]:
    """One text of each group of copies: those whose least hash of five words in a row is equal."""
    out: dict[bytes | int, bytes] = {}
    for t in texts:
        g = grams(word_hashes(t.split()), 5)
        out.setdefault(int(g.min()) if len(g) else t, t)
    return list(out.values())


def fit(texts: list[bytes], labels: list[int]) -> Scorer:
    """Even rows train the dictionaries and odd ones the calibration, within each class.

    Copies count once: a passage that is copied often would pass for a sign of its class.
    """
    by = {k: unlike([t for t, y in zip(texts, labels) if y == k]) for k in (0, 1)}
    if not by[0] or not by[1]:
        return Scorer(b"", b"", None, float(len(by[1]) > 0))
    own = {k: [b" ".join(t.translate(_LOWER).split()) for t in (v[::2] if len(v) > 1 else v)] for k, v in by.items()}
    df, n = [_shares(own[k]) for k in (0, 1)], [len(own[k]) for k in (0, 1)]
    plain = [w for t in own[0] for w in windows(t)]
    common = _content(plain[:: max(1, len(plain) // 1000)], CONTENT)
    special = {k: _content(_marked(own[k], _excess(df[k], n[k], df[1 - k], n[1 - k])), CONTENT // 2) for k in (0, 1)}
    draft = Scorer(common + b" " + special[1], special[0] + b" " + common, None)
    rest = [(t, k) for k, v in by.items() for t in (v[1::2] if len(v) > 1 else v)]
    x = np.array([draft.features(t) for t, _ in rest])
    y = np.array([k for _, k in rest], float)
    return Scorer(draft.toxic, draft.ordinary, logistic(x, y, ridge=0.3))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """Of rows with one id that with the least text is taken, and of its labels the greatest."""
    named = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(fold("id", FOLDS) != HELD_OUT)
    named = save(named.groupBy("id").agg(F.max("y").alias("y")), "toxic-labels")
    ids = [r for y in (0, 1) for r in hashed_sample(named.where(f"y = {y}"), "id", sample).collect()]
    drop(named)
    if not ids:
        return fit([], [])
    # about twice SAMPLE short rows: a bounded broadcast
    few = docs.sparkSession.createDataFrame(ids, named.schema)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), text.alias("text")).where(F.octet_length("text") <= LONGEST).join(F.broadcast(few), "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.id)
    return fit([r.text.encode() for r in rows], [r.y for r in rows])


def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))


def unlike(texts: list[bytes]) -> list[bytes]:
    """One text of each group of copies: those whose least hash of five words in a row is equal."""
    out: dict[bytes | int, bytes] = {}
    for t in texts:
        g = grams(word_hashes(t.split()), 5)
        out.setdefault(int(g.min()) if len(g) else t, t)
    return list(out.values())


def fit(texts: list[bytes], labels: list[int]) -> Scorer:
    """Even rows train the dictionaries and odd ones the calibration, within each class.

    Copies count once: a passage that is copied often would pass for a sign of its class.
    """
    by = {k: unlike([t for t, y in zip(texts, labels) if y == k]) for k in (0, 1)}
    if not by[0] or not by[1]:
        return Scorer(b"", b"", None, float(len(by[1]) > 0))
    own = {k: [b" ".join(t.translate(_LOWER).split()) for t in (v[::2] if len(v) > 1 else v)] for k, v in by.items()}
    df, n = [_shares(own[k]) for k in (0, 1)], [len(own[k]) for k in (0, 1)]
    plain = [w for t in own[0] for w in windows(t)]
    common = _content(plain[:: max(1, len(plain) // 1000)], CONTENT)
    special = {k: _content(_marked(own[k], _excess(df[k], n[k], df[1 - k], n[1 - k])), CONTENT // 2) for k in (0, 1)}
    draft = Scorer(common + b" " + special[1], special[0] + b" " + common, None)
    rest = [(t, k) for k, v in by.items() for t in (v[1::2] if len(v) > 1 else v)]
    x = np.array([draft.features(t) for t, _ in rest])
    y = np.array([k for _, k in rest], float)
    return Scorer(draft.toxic, draft.ordinary, logistic(x, y, ridge=0.3))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Scorer:
    named = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(fold("id", FOLDS) != HELD_OUT)
    ids = [r for y in (0, 1) for r in hashed_sample(named.where(f"y = {y}"), "id", sample).collect()]
    if not ids:
        return fit([], [])
    # about twice SAMPLE short rows: a bounded broadcast
    few = docs.sparkSession.createDataFrame(ids, named.schema).groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(few), "id").select("id", "text", "y").collect()
    rows.sort(key=lambda r: (r.id, r.text or ""))
    return fit([(r.text or "").encode() for r in rows], [r.y for r in rows])


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every document."""
    session(docs.sparkSession)
    scorer = train(docs, labels)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scorer.score(texts))], ["id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(apply, f"id {kind}, score double")
    held = F.coalesce(fold("id", FOLDS) == HELD_OUT, F.lit(False))
    return out.select("id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
