"""Every registered query against its SQL on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from fathomline import catalog

OWN = sorted(catalog.QUERIES)


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(str, df[cols].itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query(name, spark, sf, duck):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if (sql := catalog.ORACLE_SQL.get(name)) is None:
        assert len(got.columns) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("parts", [1, 7])
def test_partition_count_does_not_matter(parts, spark, sf):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = rows(catalog.QUERIES["domain_diversity"](spark, sf).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == rows(catalog.QUERIES["domain_diversity"](spark, sf).toPandas())
