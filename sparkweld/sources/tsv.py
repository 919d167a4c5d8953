"""Tab-separated sources and sinks.

Readers take every column as a string and turn null into the empty string. Values such as ``NA`` stay text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweld.storage import numbered

RECORD = ("entity_id", "business_name", "business_address", "country")
# Column names that stand for the record columns, the best first.
ALIASES = {
    "entity_id": ("entity_id", "id", "business_id", "record_id"),
    "business_name": ("name", "business_name", "business name", "company_name"),
    "business_address": ("address", "business_address", "business address"),
    "country": ("country", "country_code", "country code"),
}
TRUTH_ALIASES = {
    "source1_entity_id": ("s1_entity_id", "s1_id", "source1_entity_id", "entity_id", "id"),
    "matched_entity_ids": ("matched_entity_ids", "matched_ids", "matches", "matched_entity_id", "source2_source3_entity_ids"),
}
# Texts that a reader with default missing values takes as missing.
MISSING = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Words that mean an empty id list in prediction files.
EMPTY_WORDS = ("nan", "none", "null")


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, missing: bool = False) -> DataFrame:
    """SRC-1..4: a tab-separated file with a header; the required ``columns``, if given, must be there.

    ``missing``: texts that stand for a missing value (``MISSING``) become the empty string, as other readers have it.
    """
    x = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    x = x.toDF(*(c.lstrip("﻿") for c in x.columns))
    if columns is not None and (lack := [c for c in columns if c not in x.columns]):
        raise ValueError(f"{path} lacks {', '.join(lack)}")
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return x.select(*((F.when(value(c).isin(*MISSING), "").otherwise(value(c)) if missing else value(c)).alias(c) for c in (columns or x.columns)))


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """LIM-1: the first ``n`` rows of a file, in its order."""
    return numbered(rows).where(F.col("number") <= n).drop("number")


def in_chunks(rows: DataFrame, size: int, most: int | None = None) -> DataFrame:
    """LIM-1: rows of a file with the number of their ``chunk`` of ``size`` rows, of the first ``most`` chunks if given."""
    x = numbered(rows).withColumn("chunk", F.floor((F.col("number") - 1) / size)).drop("number")
    return x if most is None else x.where(F.col("chunk") < most)


def resolve(columns: Sequence[str], aliases: Sequence[str], required: bool = True) -> str | None:
    """SRC-5: the column that an alias names, exactly but for case, else one that contains an alias."""
    plain = {c.strip().lower(): c for c in reversed(columns)}
    for a in aliases:
        if a.lower() in plain:
            return plain[a.lower()]
    for a in aliases:
        for c in columns:
            if a.lower() in c.strip().lower():
                return c
    if required:
        raise ValueError(f"no column for {list(aliases)} among {list(columns)}")
    return None


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: a record file with other column names; address and country may be absent."""
    x = read_tsv(spark, path)
    cols = []
    for name, aliases in ALIASES.items():
        found = resolve(x.columns, aliases, name in ("entity_id", "business_name"))
        cols.append((F.col(f"`{found}`") if found else F.lit("")).alias(name))
    return x.select(*cols)


def with_source(records: DataFrame) -> DataFrame:
    """``source`` and ``ord`` from the id: sources in order, then the number after the dash (ids without one last)."""
    number = F.coalesce(F.regexp_extract("entity_id", r"-(\d{1,12})$", 1).try_cast("long"), F.lit((1 << 40) - 1))
    source = F.substring_index("entity_id", "-", 1)
    rank = F.coalesce(F.regexp_extract(source, r"(\d{1,3})$", 1).try_cast("long"), F.lit(999))
    return records.select("*", source.alias("source"), (rank * (1 << 40) + number).alias("ord"))


def unique_ids(records: DataFrame) -> DataFrame:
    """SRC-11: ids that occur more than once; a store that takes them would refuse."""
    return records.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1")


def refuse_repeats(records: DataFrame) -> DataFrame:
    """SRC-11: ``records`` as they are; an id that occurs twice is an error."""
    if again := [r.entity_id for r in unique_ids(records).orderBy("entity_id").limit(5).collect()]:
        raise ValueError(f"ids that occur more than once: {', '.join(map(str, again))}")
    return records


def last_wins(records: DataFrame, order: str = "ord") -> DataFrame:
    """SRC-12: the last row of each id; blank ids are skipped."""
    w = Window.partitionBy("entity_id").orderBy(F.desc(order))
    x = records.where(F.trim("entity_id") != "")
    return x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def read_ids(spark: SparkSession, path: str, column: str = "entity_id") -> DataFrame:
    """SRC-6: trimmed, distinct, not blank."""
    return read_tsv(spark, path, [column]).select(F.trim(column).alias("id")).where("id <> ''").distinct()


def split_ids(lists: DataFrame, separators: str = ",", distinct: bool = True, empty_words: bool = False) -> DataFrame:
    """SRC-7..10: pairs ``(s1_id, ref_id)`` of ``(source1_entity_id, matched_entity_ids)``; rows of one id are united.

    ``distinct=False`` keeps repeats; ``empty_words`` takes nan, none and null as an empty list.
    """
    ids = F.coalesce("matched_entity_ids", F.lit(""))
    if empty_words:
        ids = F.when(F.lower(F.trim(ids)).isin(*EMPTY_WORDS), "").otherwise(ids)
    x = lists.select(F.trim("source1_entity_id").alias("s1_id"), F.explode(F.split(ids, f"[{separators}]")).alias("ref_id"))
    x = x.select("s1_id", F.trim("ref_id").alias("ref_id")).where("ref_id <> '' and s1_id <> ''")
    return x.distinct() if distinct else x


def singletons(lists: DataFrame, separators: str = ",") -> int:
    """SRC-9: rows whose id list is empty."""
    pairs = split_ids(lists, separators, distinct=False).select("s1_id").distinct()
    return lists.select(F.trim("source1_entity_id").alias("s1_id")).where("s1_id <> ''").join(pairs, "s1_id", "left_anti").count()


def id_lists(ids: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """AGG-2, SRT-1: one row for each ``ids(s1_id)``: its sorted, comma-joined references, empty where there are none."""
    x = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("ref_id")), ",").alias(column))
    return ids.select("s1_id").distinct().join(x, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def details(ids: DataFrame, truth: DataFrame, predicted: DataFrame, scores: DataFrame) -> DataFrame:
    """SNK-5: a row for each S1 record: both id lists, the counts, and the score with eight decimals."""
    lists = id_lists(ids, truth, "true_matched_entity_ids").join(id_lists(ids, predicted, "predicted_matched_entity_ids"), "source1_entity_id")
    return lists.join(detail_rows(scores), "source1_entity_id")


def detail_rows(scores: DataFrame, true: str | None = None, predicted: str | None = None) -> DataFrame:
    """SNK-5 of rows that have the counts, the score and, if named, both id lists already."""
    lists = [F.col(c).alias(f"{k}_matched_entity_ids") for k, c in (("true", true), ("predicted", predicted)) if c is not None]
    return scores.select(F.col("s1_id").alias("source1_entity_id"), *lists, F.col("tp").alias("TP"), F.col("fp").alias("FP"), F.col("fn").alias("FN"), F.format_string("%.8f", "f05").alias("F0.5"))


def write_tsv(df: DataFrame, path: str, sort: Sequence[str] = (), single: bool = False, sep: str = "\t") -> None:
    """SNK-1..3, 5, 6: a folder of files with a header, no quotes, empty values as nothing; ``sep=","`` for metric tables.

    ``single`` makes one file of it, for small results; else ``sort`` orders the files by range.
    """
    if single:
        df = df.coalesce(1).sortWithinPartitions(*sort) if sort else df.coalesce(1)
    elif sort:
        df = df.orderBy(*sort)
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("emptyValue", "").option("nullValue", "").option("quote", "").option("lineSep", "\n").csv(path)


def write_candidates(pairs: DataFrame, path: str, chunk: str | None = None) -> None:
    """SNK-4: candidate pairs with their source as Parquet, in a folder a ``chunk`` value if named."""
    w = pairs.withColumn("candidate_source", F.substring_index("ref_id", "-", 1)).write.mode("overwrite")
    (w.partitionBy(chunk) if chunk else w).parquet(path)


def summary_text(values: dict[str, object]) -> str:
    """SNK-7: a plain report of a few figures, computed by the caller."""
    width = max(map(len, values), default=0)
    return "".join(f"{k.ljust(width)}  {v:.8f}\n" if isinstance(v, float) else f"{k.ljust(width)}  {v}\n" for k, v in values.items())
