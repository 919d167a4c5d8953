"""Queries of the corpus operators against their SQL in DuckDB, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from sparkweld.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), c.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) >= 50

    def rows(df):
        plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) else str(v)
        return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))

    assert rows(got) == rows(want)
