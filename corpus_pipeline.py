"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. ``quality``: documents that the quality classifier rejects go.
2. ``near_duplicates``: of each group of texts with a five-word-shingle Jaccard index of 0.8 or more the document with the
   smallest id stays (bit-sliced SimHash, then the sets themselves).
3. ``substrings``: word runs of 13 or more that a document with a smaller id has are cut out of the text, and
   ``n_chars`` follows; a document that is left without words stays, as an empty text.
4. ``decontamination``: documents that hold a window of a benchmark item go.
5. ``tokens``: what is left becomes token ids, one row a document, which are decoded again: ``decoded_sha256`` is that of
   the stage's text.

All stages but the last return the columns of ``documents``, unchanged but for that. Rows without an id stay where a
stage's decision needs an id; decisions about texts hold for a row, not for all rows of its id. Labels and benchmark items are read from ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkweld.llm import bpe, decontaminate, near, quality, substrings
from sparkweld.llm.common import drop, save, table

#: The vocabulary, and the pattern that splits texts before its merges.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cut(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256)``."""
    return bpe.encode(docs, bpe.load_ranks(RANKS), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), digest=True)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near),
    ("substrings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("tokens", to_tokens),
]

#: Classifiers, near-duplicate groups and byte-pair merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, saved = table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, f"stage-{name}")
            drop(*saved)
            saved = [docs]
    return docs
