"""Shared plumbing of the corpus operators: bounded Arrow slices, folds, salted joins; tables come from ``storage``."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweld.session import ship
from sparkweld.storage import drop, save, shared_dir  # noqa: F401  (the operators take them from here)

#: Text handled at once by a Python worker: bounds its memory whatever the Arrow batch holds.
SLICE_BYTES = 4 << 20


def session(spark: SparkSession) -> SparkSession:
    """Bound what an Arrow batch may hold, as rows can be very long texts, and let executors import this package.

    The two limits stay set: a lazy result is planned only when the caller uses it.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, n: int) -> Column:
    """``crc32(key as text) mod n``: the folds that the label contracts use."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % F.lit(n)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of text (one row at least).

    Yields each run with its texts as UTF-8 bytes; a null text is the empty text.
    """
    for batch in batches:
        col = batch.column(batch.schema.names.index(text)).cast(pa.large_binary())
        sizes = [x or 0 for x in pa.compute.binary_length(col).to_pylist()]
        start = 0
        while start < len(sizes):
            stop, total = start, 0
            while stop < len(sizes) and (stop == start or total + sizes[stop] <= limit):
                total += sizes[stop]
                stop += 1
            yield batch.slice(start, stop - start), [x or b"" for x in col.slice(start, stop - start).to_pylist()]
            start = stop


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salt_by: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys are dealt over ``salts`` tasks: ``small`` has one row a key and is repeated that often.

    ``salt_by`` are columns of ``big`` that spread the rows of one key.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def spread_join(big: DataFrame, small: DataFrame, on: list[str], by: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys, and only these, are dealt over several tasks.

    Column ``n`` of ``small`` (a saved table, one or few rows a key) counts the rows of ``big`` with that key; ``by`` are
    columns of ``big`` that tell the rows of a key apart. A key is hot when it has over a quarter of an even share of a
    partition, so there are at most four hot keys a partition, whose hashes reach the driver and go into the plan; they are
    dealt over a power of two of tasks. The plan is the same whether there are any. ``n`` isn't returned.
    """
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1000, (small.agg(F.sum(n)).first()[0] or 0) // (4 * parts))
    code, levels = F.xxhash64(*on), defaultdict(list)
    for r in small.where(F.col(n) > share).select(code.alias("code"), n).distinct().collect():
        levels[(-(-r[1] // share) - 1).bit_length()].append(r.code)
    salts = F.lit(1)
    for level, codes in sorted(levels.items()):  # a hash of two levels takes the higher one on both sides
        salts = F.when(code.isin(codes), 1 << level).otherwise(salts)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(n)
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def hashed_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows at most, those with the least hash of their key; the same rows on every run.

    A bound on the hash picks them in each task, so that no task sends more than its share.
    """
    share = min(1.0, n / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
