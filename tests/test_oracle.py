"""Every query with SQL is held against DuckDB on the smallest tables; the others against their own rules elsewhere."""

import glob
import os

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def values(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in registry.SQL:
        got = duck.execute(registry.SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        assert values(got.fetchall()) == values([tuple(r[n] for n in names) for r in rows])
