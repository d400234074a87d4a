"""Every registered query against its SQL form in DuckDB."""

import duckdb
import pandas as pd
import pytest

from inkflow.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda x: None if pd.isna(x) else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(map(clean, r)) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(db.sql(catalog.ORACLE_SQL[name]).df())
