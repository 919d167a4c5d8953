"""Limits: queries have the production ones, and with small ones operators still equal their SQL."""

import __spark_entry__ as e
import duckdb
import pytest

from sparkweld.operators import blocking as b
from sparkweld.operators import match
from sparkweld.plans import fixtures as fx
from sparkweld.plans import queries as q
from sparkweld.plans import sql

N = 80


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """One S1 record and ``N`` references that share its name."""
    path = str(tmp_path_factory.mktemp("hot"))
    rows = [(0, "acme north west trading goods house 1 long street", "en", 50)] + [(180 * i + 1, f"acme north west trading goods house {i} other road", "en", 50) for i in range(N)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(3 * i + (i > 0), "red part", "b", "t") for i in range(N + 1)], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{path}/part.parquet")
    return path


def test_all_matches_of_a_hot_name_are_found(spark, hot):
    ids = e.queries()["match_lists"](spark, hot).first().matched_entity_ids.split(",")
    assert len(set(ids)) == N


@pytest.mark.parametrize("name", ["block_union_ordered_cap", "block_hot_keys_cap", "block_limit_per_pass", "block_token_pass", "rule_matches", "rank_cap"])
def test_candidates_of_a_hot_name(spark, hot, name):
    assert q.QUERIES[name](spark, hot).count() == N


def test_limits_in_sql_are_the_operators(spark, hot):
    assert (sql.CAP, sql.PASS_LIMIT, sql.FINAL_CAP, sql.NEGATIVES, sql.TOKEN_FREQUENCY, sql.TOKENS_PER_RECORD) == (b.CAP, b.PASS_LIMIT, b.FINAL_CAP, match.NEGATIVES, b.TOKEN_FREQUENCY, b.TOKENS_PER_RECORD)
    assert q.QUERIES["threshold_curve"](spark, hot).count() == len(match.GRID_FINE)


@pytest.mark.parametrize("n", [1, 3, 10])
@pytest.mark.parametrize("records", ["documents", "parts"])
def test_small_caps_equal_their_sql(spark, n, records):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    s1, refs = fx.sides(getattr(fx, records)(spark, sf))
    cols = ("s1_id", "ref_id", "pass_no", "position")
    want = c.sql(f"{sql.candidates(n, sql.DOCS if records == 'documents' else sql.PARTS)} SELECT {', '.join(cols)} FROM capped").fetchall()
    assert sorted(map(tuple, b.ordered_candidates(s1, refs, n).select(*cols).collect())) == sorted(want)
    if records == "documents":
        s1, refs = fx.sides(fx.documents(spark, sf), "shared")
        want = c.sql(sql.limited(n, 2 * n)).fetchall()
        assert sorted(map(tuple, b.limited_candidates(s1, refs, n, 2 * n).select(*cols).collect())) == sorted(want)


def test_hot_keys_are_dealt_and_nothing_is_lost(spark):
    from sparkweld.storage import spread_join

    big = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id % 500) as k", "id as x")
    small = spark.range(500).selectExpr("id as k", "id * 2 as y").unionAll(spark.sql("select 7L as k, -1L as y"))
    got = spread_join(big, small, ["k"], ["x"])
    assert "_salt" in got._jdf.queryExecution().toString() and got.columns == ["k", "x", "y"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "k").collect()))


def test_the_fixture_exercises_every_canonicaliser(spark):
    """Each changes a tenth of the records at least, and no pass or rule arm is idle."""
    from pyspark.sql import functions as F

    from sparkweld.functions import keys, similarity, text

    sf = "/root/testdata/sf0.01"
    x = fx.documents(spark, sf)
    name, address = F.col("business_name"), F.col("business_address")
    pairs = {
        "expand": (text.clean_ascii(name), text.name_expanded(text.clean_ascii(name))), "address": (text.clean_ascii(address), text.address_expanded(text.clean_ascii(address))),
        "shared": (text.clean_ascii(name), text.shared_expanded(text.clean_ascii(name))), "legal": (text.clean_ascii(name), text.without_legal(text.shared_expanded(text.clean_ascii(name)))),
        "ending": (text.clean_and(name), text.without_ending(text.clean_and(name))), "short": (text.clean_and(address), text.address_shortened(text.clean_and(address))),
        "chained": (text.clean_tail(name), text.name_chained(text.clean_tail(name))), "postal": (F.lit(""), keys.postal(address)), "country": (F.lit(""), F.when(F.col("country") == "", "x").otherwise("")),
    }
    r = x.agg(F.count("*").alias("n"), *(F.count(F.when(a != c, 1)).alias(k) for k, (a, c) in pairs.items())).first().asDict()
    assert all(r[k] >= 0.09 * r["n"] for k in pairs), r
    s1, refs = fx.sides(x)
    n = {p.name: b.block(s1, refs, p).count() for p in b.PASSES}
    assert min(n.values()) > 0 and n["canonical"] > n["name"], n
    f = similarity.features(b.fetch(b.ordered_candidates(s1, refs), s1, refs))
    best = lambda w: F.greatest(*(F.col(f"{w}_{s}") for s in ("lev", "tok", "char")))
    third = f.where((best("name") < 88) & (best("name") >= 85) & (F.col("postal_match") == 1)).count()
    second = f.where((best("name") < 95) & (best("name") >= 88) & (best("address") >= 70)).count()
    assert second > 0 and third > 0, (second, third)
