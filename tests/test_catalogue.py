"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumenframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, sf_dir, con, name):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(map(plain, r))) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == sorted(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())
