"""The queries that have SQL, against DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from tidemark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))
