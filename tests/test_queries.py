"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from stratum.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def shown(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return repr(round(v, 6))
        return str(v.tolist() if hasattr(v, "tolist") else v)

    return sorted("|".join(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, D).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert os.path.exists(os.path.join(os.path.dirname(os.path.abspath(__spark_entry__.__file__)), "bench.py"))
