"""The star-schema tables as entity records.

``documents``: id ``S<doc_id mod 3 + 1>-<doc_id>``; words 1 to 6 and a legal form as name; words 7 to 16, a kind of street
and a postal code as address; ``lang`` as country. The number of the document picks the forms, slips into two in five names and leaves every fourth
postal code and every tenth country out, so copies of one text are noisy records of one entity. Words 17 to 40 of one
language tell entities apart: the first S1 record of an entity is its own, and all S2 and S3 records of it match that one.
Records use these forty words; the rest of a text is no part of them. ``part``: ``p_name`` as name, brand and type as
address: few distinct names, so its keys are hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweld.functions.keys import PROFILES
from sparkweld.sources.tsv import with_source
from sparkweld.storage import save

LEGAL = ("", "", "", "", " Pvt. Ltd.", " Private Limited", " & Co.", " Inc", " Incorporated", " Corp.", " LLC", " Limited")
#: What two in five names of six words have at the end of the second one.
SLIPS = ("zq ", "zqxjkv ")
STREETS = ("", " St.", " Street", " Rd", " Road", " Ave.", " Avenue", " Hwy", " Highway", " Lane", " Building", " Sector")


def _words(c: str):
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " ")), " ")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(entity_id, business_name, business_address, country, rest)``."""
    lang = F.coalesce("lang", F.lit(""))
    x = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", lang.alias("lang"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"), _words("text").alias("w"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    # by thirds of the number, as the sources go by its remainder of three
    form = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (F.floor(F.col("doc_id") / by) % len(xs) + 1).cast("int"))
    postal = F.when(F.col("doc_id") % 4 == 3, "").otherwise(F.concat(F.lit(", "), (10000 + F.col("n_chars") * 7919 % 90000).cast("string")))
    fifth = F.floor(F.col("doc_id") / 3) % 5
    slip = F.element_at(F.array(*map(F.lit, SLIPS)), F.greatest(fifth - 2, F.lit(1)).cast("int"))
    name = F.when((F.size("w") >= 6) & (fifth >= 3), F.concat(part(1, 2), slip, part(3, 4))).otherwise(part(1, 6))
    rest = F.when(F.size("w") < 17, "").otherwise(F.concat("lang", F.lit(":"), part(17, 24)))
    return x.select(
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.trim(F.concat(name, form(LEGAL, 3))).alias("business_name"), F.trim(F.concat(part(7, 10), form(STREETS, 3), postal)).alias("business_address"),
        F.when(F.col("doc_id") % 10 == 9, "").otherwise(F.col("lang")).alias("country"), rest.alias("rest"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/part.parquet")
    return x.select(
        F.concat(F.lit("S"), (F.col("p_partkey") % 3 + 1).cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"),
        F.col("p_name").alias("business_name"), F.concat_ws(" ", "p_brand", "p_type").alias("business_address"), F.lit("").alias("country"),
    )


def sides(records: DataFrame, profile: str = "ascii", name: str = "prepared") -> tuple[DataFrame, DataFrame]:
    """Prepared S1 and reference (S2, S3) records, written once: what follows reads keys and no raw record."""
    x = PROFILES[profile].prepare(with_source(records)).withColumn("own", F.col("source") == "S1")
    x = save(x, name, "own")
    return x.where("own").drop("own"), x.where("not own").drop("own")


def truth(records: DataFrame) -> DataFrame:
    """``(s1_id, ref_id)``: S1 has one record an entity, the first; so a group of copies gives a row each and no pairs."""
    x = with_source(records).where("rest <> ''").select("entity_id", "source", "ord", "rest")
    first = x.where("source = 'S1'").groupBy("rest").agg(F.min_by("entity_id", "ord").alias("s1_id"))
    return x.where("source <> 'S1'").select("rest", F.col("entity_id").alias("ref_id")).join(first, "rest").select("s1_id", "ref_id")


def ids(s1: DataFrame) -> DataFrame:
    return s1.select(F.col("entity_id").alias("s1_id"))
