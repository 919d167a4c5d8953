"""Every registered query of the matching engine against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from sparkweld.plans import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracle(spark, sf, db, name):
    got, want = q.QUERIES[name](spark, sf).toPandas(), db.sql(q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES) - {"gbt_matches"}))
def test_others_run(spark, sf, name):
    assert q.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
