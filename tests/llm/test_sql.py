"""The queries with SQL are held against DuckDB, on the smallest tables and, for licences, on texts that hold every kind of place."""

import glob
import os

import duckdb
import pytest

from tessera.llm import licenses
from tessera.llm.entry import QUERIES, SQL
from tests.llm.test_licenses import TEXTS


def agree(spark, folder, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        duck.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{files}'")
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    want = got.fetchall()
    df = QUERIES[name](spark, folder)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(SQL))
def test_on_the_smallest_tables(spark, name):
    agree(spark, "/root/testdata/sf0.001", name)


def test_licenses_of_every_kind(spark, tmp_path):
    texts = [*TEXTS, *(t for _, t, _ in licenses.TEMPLATES), *(f"z {p}, {p} z" for p, _ in licenses.PHRASES)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    agree(spark, str(tmp_path), "op3_license_scan")
