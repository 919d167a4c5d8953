"""Files in, files out: ``python -m sparkweld.cli match`` and ``python -m sparkweld.cli validate``.

``match`` reads the three sources, matches them, writes ``matching_results.tsv`` and ``candidate_pairs.tsv`` and validates
both; with the truth it also writes details for each S1 record, metrics and a summary. The exit status is the validator's.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweld.functions import similarity as sim
from sparkweld.operators import blocking, match, metrics, validate
from sparkweld.plans import fixtures
from sparkweld.session import local_session, ship
from sparkweld.sources import tsv
from sparkweld.storage import save


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    out = tsv.read_any(spark, paths[0])
    for p in paths[1:]:
        out = out.unionByName(tsv.read_any(spark, p))
    return out


def _report(found: DataFrame) -> int:
    for r in validate.report(found).orderBy("severity", "rule").collect():
        print(f"{r.severity:8} {r.rule} {validate.RULES[r.rule]}: {r.n} ({r.examples})")
    return validate.status(found)


def run_match(spark: SparkSession, sources: list[str], out: str, truth: str | None = None, profile: str = "unicode", first: int | None = None) -> int:
    """``first``: the first so many S1 records only, in file order."""
    s1_records = tsv.read_any(spark, sources[0])
    if first is not None:
        s1_records = tsv.first_rows(s1_records, first)
    records = tsv.refuse_repeats(s1_records.unionByName(_records(spark, sources[1:])))
    s1, refs = fixtures.sides(records, profile)
    ids = fixtures.ids(s1)
    candidates = save(blocking.ordered_candidates(s1, refs), "candidates")
    matches = save(match.rule_matches(sim.features(blocking.fetch(candidates, s1, refs), least_name=match.WITH_POSTAL)).select("s1_id", "ref_id"), "matches")
    files = [f"{out}/matching_results.tsv", f"{out}/candidate_pairs.tsv"]
    tsv.write_tsv(tsv.id_lists(ids, matches), files[0], ("source1_entity_id",), single=True)
    tsv.write_tsv(tsv.id_lists(ids, candidates, "candidate_entity_ids"), files[1], ("source1_entity_id",), single=True)
    if truth is not None:
        x = tsv.read_tsv(spark, truth)
        lists = x.select(*(F.col(f"`{tsv.resolve(x.columns, names)}`").alias(c) for c, names in tsv.TRUTH_ALIASES.items()))
        pairs = tsv.split_ids(lists, ",;").join(ids, "s1_id", "left_semi")
        scores = save(metrics.entities(ids, pairs, matches), "scores")
        tsv.write_tsv(tsv.details(ids, pairs, matches, scores), f"{out}/f05_entity_details.tsv", ("source1_entity_id",), single=True)
        recall = metrics.recall(candidates, pairs)
        tsv.write_tsv(recall.orderBy("pass_no"), f"{out}/blocking_results.csv", single=True, sep=",")
        stats, whole, macro = (f.first().asDict() for f in (metrics.candidate_stats(ids, candidates), metrics.overall(scores), metrics.macro(scores)))
        sizes = {f"{r.source} rows": r.n for r in refs.groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()}
        text = tsv.summary_text({"S1 rows": stats["n_s1"], **sizes, "candidate cap": blocking.CAP, **{k: v for k, v in stats.items() if k != "n_s1"}, **whole, "exact sets": macro["exact_sets"], "macro F0.5": macro["macro_f05"]})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary")
        print(text, end="")
    required, valid = s1_records.select(F.trim("entity_id").alias("s1_id")), refs.select(F.col("entity_id").alias("id"))
    return _report(validate.validate(spark, *files, required, valid))


def run_validate(spark: SparkSession, matching: str, candidates: str | None, s1: str | None, others: list[str]) -> int:
    required = None if s1 is None else tsv.read_ids(spark, s1).withColumnRenamed("id", "s1_id")
    valid = None
    for p in others:
        more = tsv.read_ids(spark, p)
        valid = more if valid is None else valid.unionByName(more)
    return _report(validate.validate(spark, matching, candidates, required, valid))


def main(args: list[str], spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkweld")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("match")
    m.add_argument("sources", nargs="+", help="S1 and one file or more of references")
    m.add_argument("--out", required=True)
    m.add_argument("--truth")
    m.add_argument("--profile", default="unicode")
    m.add_argument("--first", type=int)
    v = sub.add_parser("validate")
    v.add_argument("matching")
    v.add_argument("--candidates")
    v.add_argument("--s1")
    v.add_argument("--others", nargs="*", default=[])
    a = p.parse_args(args)
    spark = ship(spark or SparkSession.getActiveSession() or local_session())
    if a.command == "match":
        return run_match(spark, a.sources, a.out, a.truth, a.profile, a.first)
    return run_validate(spark, a.matching, a.candidates, a.s1, a.others)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
