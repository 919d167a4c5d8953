"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a Gaussian whose covariance is shrunk towards the pooled variances; a document's score comes from the
difference of the two log densities, each a Mahalanobis distance through the class's cached Cholesky factor, put
through a logistic calibration. The statistics are computed once for every document; the fit takes a bounded sample
of labelled rows (about ``SAMPLE`` at most, those with the lowest hash of the id).

Defined cases: null and empty texts have the statistics of a text without words and get a score as others do; without
labelled rows of both classes every score is the share of label 1 (0.5 without any label); repeated rows keep their
rows; rows without an id are never held out; extra columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweld.llm.common import drop, fold, hashed_sample, save, session, slices, table

#: Labelled rows that the fit takes, about at most.
SAMPLE = 20_000
#: Weight of the pooled variances in a class's covariance.
SHRINK = 0.05
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
NAMES = ("log_words", "word_len", "upper", "digit", "symbol", "bar", "unique", "repeat", "line_dup", "line_len", "stop", "wide")


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of transformed statistics for each UTF-8 text: ratios as square roots, sizes as logarithms."""
    out = np.zeros((len(texts), len(NAMES)))
    for i, text in enumerate(texts):
        n = max(1, len(text))
        count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        w = max(1, len(words))
        lines = [x for x in text.split(b"\n") if x]
        upper, digit, bar = count[65:91].sum(), count[48:58].sum(), count[124]
        stop = count[46] + count[44] + count[33] + count[63]  # . , ! ?
        symbol = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum() - count[46] - count[44]
        same = sum(map(operator.eq, words, words[1:]))
        out[i] = (
            np.log1p(len(words)), np.log1p((n - w) / w), np.sqrt(upper / n), np.sqrt(digit / n), np.sqrt(symbol / n), np.sqrt(bar / w),
            np.log((len(set(words)) + 1) / (w + 1)), np.sqrt(same / w), np.sqrt(1 - len(set(lines)) / max(1, len(lines))),
            np.log1p(w / max(1, len(lines))), np.sqrt(stop / w), np.sqrt(count[128:].sum() / n),
        )
    return out


@dataclass(frozen=True)
class Model:
    """Class means, inverse Cholesky factors and log normalisers (label 0, label 1), and the calibration's slope and offset."""

    mean: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 less that of label 0."""
        d = [c - 0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) for m, inv, c in zip(self.mean, self.inverse, self.constant)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * np.arcsinh(self.difference(x)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients (the last is the offset) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(b))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(x: np.ndarray, y: np.ndarray, shrink: float = SHRINK) -> Model:
    """``x``: statistics, ``y``: labels 0 and 1. With one class only, the score is a constant."""
    d = len(NAMES)
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Model(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), 0.0, float(np.log(p / (1 - p))))
    pooled = np.diag(x.var(axis=0) + 1e-6)
    means, inverses, constants = [], [], []
    for k in (0, 1):
        own = x[y == k]
        cov = (1 - shrink) * np.cov(own, rowvar=False, bias=True) + shrink * pooled
        chol = np.linalg.cholesky(cov)
        means.append(own.mean(axis=0))
        inverses.append(np.linalg.inv(chol))
        constants.append(np.log(len(own) / len(y)) - np.log(np.diag(chol)).sum())
    raw = Model(np.array(means), np.array(inverses), np.array(constants), 1.0, 0.0)
    slope, offset = logistic(np.arcsinh(raw.difference(x))[:, None], y.astype(float))
    return Model(raw.mean, raw.inverse, raw.constant, max(float(slope), 0.0), float(offset))


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x)``: the statistics of every document."""
    session(docs.sparkSession)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            x = statistics(texts)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), flat], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, x array<double>")


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """``stats(id, x)`` and ``labels(doc_id, <label>)``: the fit of the rows outside the held-out fold.

    Of rows with one id one is taken, and of its labels the greatest, so that repeats can't pass the sample's bound.
    """
    named = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(fold("id", FOLDS) != HELD_OUT)
    named = save(named.groupBy("id").agg(F.max("y").alias("y")), "quality-labels")
    taken = hashed_sample(named, "id", sample).join(stats, "id").groupBy("id", "y").agg(F.min("x").alias("x")).collect()
    drop(named)
    taken.sort(key=lambda r: r.id)
    return fit(np.array([r.x for r in taken]).reshape(-1, len(NAMES)), np.array([r.y for r in taken], dtype=int))


def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * np.arcsinh(self.difference(x)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients (the last is the offset) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(b))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(x: np.ndarray, y: np.ndarray, shrink: float = SHRINK) -> Model:
    """``x``: statistics, ``y``: labels 0 and 1. With one class only, the score is a constant."""
    d = len(NAMES)
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Model(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), 0.0, float(np.log(p / (1 - p))))
    pooled = np.diag(x.var(axis=0) + 1e-6)
    means, inverses, constants = [], [], []
    for k in (0, 1):
        own = x[y == k]
        cov = (1 - shrink) * np.cov(own, rowvar=False, bias=True) + shrink * pooled
        chol = np.linalg.cholesky(cov)
        means.append(own.mean(axis=0))
        inverses.append(np.linalg.inv(chol))
        constants.append(np.log(len(own) / len(y)) - np.log(np.diag(chol)).sum())
    raw = Model(np.array(means), np.array(inverses), np.array(constants), 1.0, 0.0)
    slope, offset = logistic(np.arcsinh(raw.difference(x))[:, None], y.astype(float))
    return Model(raw.mean, raw.inverse, raw.constant, max(float(slope), 0.0), float(offset))


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x)``: the statistics of every document."""
    session(docs.sparkSession)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            x = statistics(texts)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), flat], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, x array<double>")


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """``stats(id, x)`` and ``labels(doc_id, <label>)``: the fit of the rows outside the held-out fold."""
    named = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(fold("id", FOLDS) != HELD_OUT)
    taken = hashed_sample(named, "id", sample).join(stats, "id").select("x", "y").collect()
    return fit(np.array([r.x for r in taken]).reshape(-1, len(NAMES)), np.array([r.y for r in taken], dtype=int))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every document."""
    stats = save(featurise(docs), "quality")
    model = train(stats, labels)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.score(np.array(b.column(1).flatten()).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["id", "score"])

    scored = stats.mapInArrow(apply, f"id {stats.schema['id'].dataType.simpleString()}, score double")
    held = F.coalesce(fold("id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that the classifier accepts, with all their columns. Text is read twice and never shuffled."""
    stats = save(featurise(docs), "quality")
    model = train(stats, labels)
    drop(stats)

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            yield rows.filter(pa.array(model.score(statistics(texts)) >= threshold))

    return docs.mapInArrow(choose, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")
