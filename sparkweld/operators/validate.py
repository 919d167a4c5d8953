"""Checks of result files: a matching file and, optionally, a candidate file.

Files are read as lines and split at tabs alone, without quoting: a third column stays part of the last id.
Findings are rows ``(rule, severity, item)``; a report takes up to five sorted examples of each rule. Warnings never fail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweld.storage import numbered

MATCHES = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")
EXAMPLES = 5
FATAL, ERROR, WARNING = "fatal", "error", "warning"
#: Rule numbers and what they find.
RULES = {
    "VAL-01": "the file is missing or empty",
    "VAL-02": "the header has commas and no tab",
    "VAL-03": "the header isn't the expected one",
    "VAL-04": "a line without a tab",
    "VAL-05": "an S1 id with several rows",
    "VAL-06": "an id repeated in a list",
    "VAL-07": "an S1 id in a list",
    "VAL-08": "an id without the prefix S2- or S3-",
    "VAL-09": "an id that no target source has",
    "VAL-10": "an S1 record without a row",
    "VAL-11": "a row for an S1 id that the test set lacks",
    "VAL-12": "no candidate file",
    "VAL-13": "a match that isn't a candidate",
    "VAL-14": "ids weren't checked",
    "VAL-15": "the test set's S1 file is missing",
    "VAL-16": "the file can't be read as UTF-8",
}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, number)``: lines of one file with their numbers, from 1 on."""
    return numbered(spark.read.text(path).select(F.col("value").alias("line")))


def rows_of(lines: DataFrame, header: str) -> DataFrame:
    """``(number, s1_id, ids)`` of the lines with a tab but the header; ``ids`` as they stand, not trimmed."""
    body = lines.where((F.col("line") != header) & (F.trim("line") != "") & F.contains("line", F.lit("\t")))
    parts = F.split("line", "\t", 2)
    return body.select("number", F.trim(parts[0]).alias("s1_id"), F.rtrim(parts[1]).alias("text")).select(
        "number", "s1_id", F.when(F.trim("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", ",")).alias("ids")
    )


def row_findings(rows: DataFrame, required: DataFrame | None = None, valid: DataFrame | None = None) -> DataFrame:
    """VAL-05..11 of ``rows(s1_id, ids)``; ``required(s1_id)`` and ``valid(id)`` as far as they are known."""

    def finding(x: DataFrame, rule: str, item: str) -> DataFrame:
        return x.select(F.lit(rule).alias("rule"), F.lit(ERROR).alias("severity"), F.col(item).cast("string").alias("item"))

    each = rows.select("s1_id", F.explode("ids").alias("id"))
    own, other = F.startswith("id", F.lit("S1-")), F.startswith("id", F.lit("S2-")) | F.startswith("id", F.lit("S3-"))
    found = [
        finding(rows.groupBy("s1_id").agg(F.count("*").alias("n")).where("n > 1"), "VAL-05", "s1_id"),
        finding(rows.where(F.size("ids") != F.size(F.array_distinct("ids"))).distinct(), "VAL-06", "s1_id"),
        finding(each.where(own).select("id").distinct(), "VAL-07", "id"),
        finding(each.where(~own & ~other).select("id").distinct(), "VAL-08", "id"),
    ]
    if valid is not None:
        found.append(finding(each.where(other).select("id").distinct().join(valid, "id", "left_anti"), "VAL-09", "id"))
    if required is not None:
        need, have = required.select("s1_id").distinct(), rows.select("s1_id").distinct()
        found += [finding(need.join(have, "s1_id", "left_anti"), "VAL-10", "s1_id"), finding(have.join(need, "s1_id", "left_anti"), "VAL-11", "s1_id")]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def outside(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """VAL-13: S1 ids whose matches aren't all candidates; of several rows of one id the last one counts."""

    def pairs(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("s1_id").agg(F.max_by("ids", "number").alias("ids"))
        return last.select("s1_id", F.explode("ids").alias("id")).distinct()

    x = pairs(matches).join(pairs(candidates), ["s1_id", "id"], "left_anti").select("s1_id").distinct()
    return x.select(F.lit("VAL-13").alias("rule"), F.lit(WARNING).alias("severity"), F.col("s1_id").alias("item"))


def counts(rows: DataFrame) -> DataFrame:
    """VAL-18: rows, rows with and without ids, and ids."""
    return rows.agg(F.count("*").alias("n_rows"), F.count(F.when(F.size("ids") == 0, 1)).alias("n_empty"), F.count(F.when(F.size("ids") > 0, 1)).alias("n_filled"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n_ids"))


def file_findings(spark: SparkSession, path: str, expected: tuple[str, str], required: DataFrame | None, valid: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """VAL-01..11 and 16 of one file: its rows (None after a fatal finding) and its findings."""

    def fatal(rule: str, item: str) -> tuple[None, DataFrame]:
        return None, spark.createDataFrame([(rule, FATAL, item)], "rule string, severity string, item string")

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return fatal("VAL-01", path)
    lines = _lines(spark, path)
    head = lines.orderBy("number").select("line").first()
    if head is None:
        return fatal("VAL-01", path)
    header = head.line
    if not lines.where(~F.is_valid_utf8("line")).isEmpty():
        return fatal("VAL-16", path)
    plain = header.lstrip("﻿")
    if "," in plain and "\t" not in plain:
        return fatal("VAL-02", plain)
    if tuple(c.strip().lower() for c in plain.split("\t")) != expected:
        return fatal("VAL-03", plain)
    rows = rows_of(lines, header)
    bad = lines.where((F.trim("line") != "") & ~F.contains("line", F.lit("\t"))).select(F.lit("VAL-04").alias("rule"), F.lit(ERROR).alias("severity"), F.concat("number", F.lit(": "), F.left("line", F.lit(80))).alias("item"))
    return rows, bad.unionByName(row_findings(rows, required, valid))


def validate(spark: SparkSession, matching: str, candidate: str | None, required: DataFrame | None, valid: DataFrame | None = None) -> DataFrame:
    """All findings of a submission."""

    def warn(rule: str, item: str, severity: str = WARNING) -> DataFrame:
        return spark.createDataFrame([(rule, severity, item)], "rule string, severity string, item string")

    out = warn("VAL-14", "ids") if valid is None else spark.createDataFrame([], "rule string, severity string, item string")
    if required is None:
        return out.unionByName(warn("VAL-15", "source1", FATAL))
    rows, found = file_findings(spark, matching, MATCHES, required, valid)
    out = out.unionByName(found)
    if candidate is None:
        return out.unionByName(warn("VAL-12", "candidates"))
    more, found = file_findings(spark, candidate, CANDIDATES, required, valid)
    out = out.unionByName(found)
    return out.unionByName(outside(rows, more)) if rows is not None and more is not None else out


def report(findings: DataFrame) -> DataFrame:
    """VAL-17: number and up to five sorted examples of each rule."""
    # the least five of each task, then of all: no rule's items meet in one place
    from pyspark.sql import Window

    w = Window.partitionBy("rule", "severity").orderBy("item")
    items = findings.distinct()
    first = items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= EXAMPLES).groupBy("rule", "severity").agg(F.array_join(F.array_sort(F.collect_list("item")), ", ").alias("examples"))
    return items.groupBy("rule", "severity").agg(F.count("*").alias("n")).join(first, ["rule", "severity"])


def status(findings: DataFrame) -> int:
    """VAL-17: the exit status, 0 or 1; warnings never fail."""
    return 0 if passed(findings) else 1


def passed(findings: DataFrame) -> bool:
    return findings.where(F.col("severity") != WARNING).isEmpty()
