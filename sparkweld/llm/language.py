"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a binary classifier over hashed byte n-grams (a linear log-odds model,
fitted from n-gram counts of all training documents) predicts on which side the text is. Decoding weighs the losses of
all bits: the language whose codeword has the least total logistic loss wins, and a small lead over the second flags
the text as ambiguous.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text where nothing could be
learned. Rows without an id are training rows of fold null, hence never used for learning and never held out. Equal
texts get equal predictions; ties go to the language that sorts first; over ``LANGUAGES`` languages are refused, none is
dropped; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweld.llm.common import drop, fold, save, session, slices, table

FOLDS, HELD_OUT = 3, 1
#: Buckets of hashed n-grams, and the lengths of these in bytes.
BUCKETS = 4096
ORDERS = (2, 3, 4)
#: Languages at most: their counts, a row a bucket, reach the driver.
LANGUAGES = 1000
AMBIGUOUS = 0.1
#: Documents whose count vectors a worker holds at once.
GROUP = 256
# lower-cases A-Z and makes other ASCII characters that are no letters blank
_CLEAN = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace"))) if text else False


def counts(texts: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Hashed n-gram counts, one row a text."""
    clean = [b" " + b" ".join(t.translate(_CLEAN).split()) + b" " for t in texts]
    sizes = np.fromiter(map(len, clean), np.int64, len(clean))
    data = np.frombuffer(b"".join(clean), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(clean)), sizes)
    out = np.zeros(len(texts) * buckets, np.int64)
    for n in ORDERS:
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            code = (code ^ data[j : len(data) - n + 1 + j]) * np.uint32(0x85EBCA6B)
            code ^= code >> np.uint32(13)
        inside = owner[: len(code)] == owner[n - 1 :]
        out += np.bincount((owner[: len(code)] * buckets + code % np.uint32(buckets))[inside], minlength=len(out))
    return out.reshape(len(texts), buckets)


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages, two of which differ in half of the bits: rows of a Hadamard matrix.

    The matrix is twice as large as it need be, at least 16, so that a few wrong bits leave the nearest row the right one;
    a column that is the same for all languages is no bit.
    """
    code = np.ones((1, 1))
    while len(code) < max(16, 2 * n):
        code = np.block([[code, code], [code, -code]])
    code = code[1 : n + 1]
    return code[:, np.abs(code.sum(axis=0)) < n] if n > 1 else np.ones((n, 1))


@dataclass(frozen=True)
class Model:
    names: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: float = 8.0

    def decode(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each row of counts."""
        if not self.names:
            return ["und"] * len(x), np.zeros(len(x)), np.ones(len(x), bool)
        total = np.maximum(x.sum(axis=1, keepdims=True), 1)
        margin = np.tanh(x @ self.weights.T / total) * self.scale * np.minimum(1, np.sqrt(total / 50))
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]).sum(axis=2)
        gain = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share = gain / gain.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        top = np.sort(share, axis=1)
        lead = top[:, -1] - top[:, -2] if len(self.names) > 1 else np.ones(len(x))
        return [self.names[i] for i in best], share[np.arange(len(x)), best], lead < AMBIGUOUS


def train(docs: DataFrame) -> Model:
    """From ``docs(doc_id, text, lang)``: n-gram counts by language over every training document."""
    session(docs.sparkSession)

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, texts in slices(batches):
            langs = rows.column(0).to_pylist()
            for i in range(0, len(texts), GROUP):
                x = counts(texts[i : i + GROUP])
                part = np.array(langs[i : i + GROUP], dtype=object)
                for lang in set(part):
                    sums[lang] = sums.get(lang, 0) + x[part == lang].sum(axis=0)
        for lang, x in sums.items():
            at = np.nonzero(x)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(x[at])], ["lang", "bucket", "n"])

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(fold("doc_id", FOLDS) != HELD_OUT)
    rows = known.select("lang", "text").mapInArrow(tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = save(rows, "n-grams")
    names = sorted(r.lang for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    x, at = np.zeros((len(names), BUCKETS)), {lang: i for i, lang in enumerate(names)}
    for r in rows.collect():
        x[at[r.lang], r.bucket] = r.n
    drop(rows)
    return model_of(names, x)


def model_of(names: list[str], x: np.ndarray) -> Model:
    """``x``: n-gram counts by language. Each bit's weights are log odds of its two sides, languages weighing alike."""
    code = codewords(len(names))
    share = (x + 0.5) / (x + 0.5).sum(axis=1, keepdims=True) if len(names) else x
    weights = np.zeros((code.shape[1] if len(names) else 0, BUCKETS))
    for k in range(len(weights)):
        up, down = share[code[:, k] > 0], share[code[:, k] < 0]
        if len(up) and len(down):
            weights[k] = np.log(up.mean(axis=0) / down.mean(axis=0))
    return Model(names, code, weights)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(id, held_out, lang_pred, score, ambiguous)`` for every document of ``docs(doc_id, text[, lang])``."""
    model = model or train(docs)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            lang, score, unsure = [], [], []
            for i in range(0, len(texts), GROUP):
                some = texts[i : i + GROUP]
                a, b, c = model.decode(counts(some))
                ok = np.array([has_letter(t) for t in some], bool)
                lang += [x if y else "und" for x, y in zip(a, ok)]
                score += np.where(ok & (np.array(lang[i:]) != "und"), b, 0.0).tolist()
                unsure += np.where(ok, c, True).tolist()
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = session(docs.sparkSession) and docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(apply, f"id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.select("id", F.coalesce(fold("id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
