"""Every registered query of the library against its DuckDB twin over the same Parquet."""

import duckdb
import pandas as pd
import pytest

from lamella.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def shown(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, str) or hasattr(v, "year") or "bool" in type(v).__name__:
        return str(v)
    return repr(float(v))


def canonical(df):
    cols = sorted(df.columns)
    return sorted(tuple(map(shown, row)) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, sf, name):
    want, got = duck.execute(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert canonical(want) == canonical(got)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["macro_scores", "shards", "facets_contextual", "nearest", "split_by_budget"])
def test_any_partitioning(spark, sf, name):
    """The same rows whatever the number of shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = canonical(registry.QUERIES[name](spark, sf).toPandas())
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        many = canonical(registry.QUERIES[name](spark, sf).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == many
