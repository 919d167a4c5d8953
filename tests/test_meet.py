"""Capped candidates in blocks: no pair is shuffled, and the result is that of the join, window and cap."""

import re

import pytest
from pyspark.sql import functions as F

from sparkweld.operators import blocking as b
from sparkweld.operators import match, meet
from sparkweld.plans import fixtures as fx
from sparkweld.plans import queries as q
from tests.test_operators import records

#: Queries, and whether their rows leave the blocks as a row an S1 record.
SETTLED = {"candidate_stats": True, "label_pairs": False, "negatives_cap": False, "block_hot_keys_cap": False, "block_token_pass": False, "pass_contribution": True, "block_unicode_cap": False, "block_union_ordered_cap": False, "candidate_lists_wide": True, "candidate_percentiles": True, "candidates_long": False}


@pytest.mark.parametrize("name", sorted(SETTLED))
def test_no_pair_is_shuffled(spark, sf, name):
    lines = q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    above = [x for x in lines[:at] if "Exchange" in x]
    assert ("new_pairs" in lines[at]) if SETTLED[name] else not above


def plain(s1, refs, n):
    return b.cap(b.union_ordered(b.candidates(s1, refs, b.PASSES)), n)


@pytest.mark.parametrize("n", [2, 7, 1000])
def test_blocks_equal_join_and_cap(spark, n):
    s1, refs = fx.sides(records(spark, 200, seed=n))
    refs = refs.unionByName(refs.where("ord % 10 = 0"))  # ids that occur twice
    want = sorted(map(tuple, plain(s1, refs, n).select("s1_id", "ref_id", "pass_no", "ord", "position").collect()))
    assert sorted(map(tuple, b.ordered_candidates(s1, refs, n).select("s1_id", "ref_id", "pass_no", "ord", "position").collect())) == want


def test_labels_and_negatives_in_blocks(spark):
    s1, refs = fx.sides(records(spark, 200))
    pairs = plain(s1, refs, 20)
    truth = pairs.where(F.col("position") % 3 == 0).select("s1_id", "ref_id").unionAll(spark.createDataFrame([("S1-0", "S2-none"), ("S1-none", "S2-1")], "s1_id string, ref_id string"))
    labelled = match.label(pairs, truth)
    cols = ("s1_id", "ref_id", "label")
    rows = lambda x: sorted(map(tuple, x.select(*cols).collect()))
    assert rows(b.ordered_candidates(s1, refs, 20, truth)) == rows(labelled)
    assert rows(b.ordered_candidates(s1, refs, 20, truth, negatives=2)) == rows(match.cap_negatives(labelled, 2))
    assert rows(b.ordered_candidates(s1, refs, 20, truth, positives=True)) == rows(labelled.where("label = 1"))
    assert rows(b.ordered_candidates(s1, refs, 20, truth, negatives=0)) == rows(labelled.where("label = 1"))


def test_counts_and_lists_in_blocks(spark):
    s1, refs = fx.sides(records(spark, 200))
    pairs = plain(s1, refs, 1000).collect()
    got = {r.s1_id: r for r in b.ordered_counts(s1, refs, None, ids=True).collect()}
    assert len(got) == s1.count()
    for s, r in got.items():
        own = [p for p in pairs if p.s1_id == s]
        assert r.n == len(own) and r.ids == ",".join(sorted(p.ref_id for p in own))
        assert r.new_pairs == [sum(p.pass_no == k for p in own) for k in range(1, 11)]


def test_texts_move_packed_and_once_a_reference(spark, monkeypatch):
    """Before the blocks no row is shuffled for each reference of each block, also with more blocks than bits."""
    s1, refs = fx.sides(records(spark, 600))  # 200 of S1
    found = b.scored_candidates(s1, refs)
    want = sorted(map(tuple, found.collect()))
    deal = meet._blocks
    monkeypatch.setattr(meet, "_blocks", lambda s1, by, most: deal(s1, by, 3))
    many = b.scored_candidates(s1, refs)
    for x in (found, many):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "packed#" in plan and not re.search(r"hashpartitioning\(block#\d+, entity_id#\d+", plan)
    assert sorted(map(tuple, many.collect())) == want and len(want) > 1000
