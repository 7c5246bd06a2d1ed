"""Every query with SQL gives the same rows as the SQL on the small tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def own():
    from driftlode.plans.queries import ORACLE_SQL, QUERIES

    return QUERIES, ORACLE_SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def sorted_rows(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(own()[1]))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    queries, sql = own()
    a, b = sorted_rows(queries[name](spark, sf_dir).toPandas()), sorted_rows(duck.execute(sql[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), (c, a[~same].head(), b[~same].head())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_ensemble_probabilities(spark, sf_dir):
    got = own()[0]["backtrack_ensemble"](spark, sf_dir).toPandas()
    sums = got.groupby("detection").p.sum()
    assert np.allclose(sums, 1) and (got.p >= 0).all() and len(sums) == 10


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
